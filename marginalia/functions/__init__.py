"""Column functions: patterns, paths, markdown pieces, HTML text."""
