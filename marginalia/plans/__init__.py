"""Whole reports composed from the operators."""
