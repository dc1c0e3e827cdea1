"""Small tables with the odd cases that every operator has to bear."""

from __future__ import annotations

LONG = ("The quick brown fox jumps over the lazy dog near bank number 7. " * 4000) + "end"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, n_tokens string, "
    "row string, host string, score string, words string, `group` string, key string, kept string, size string, copy int"
)
TEXTS = [
    (1, "One text of some words, which says a few things about nothing at all.", "s1"),
    (2, None, "s1"),
    (3, "", None),
    (4, " \t\n ", "s2"),
    (5, LONG, "s1"),
    (6, "One text of some words, which says a few things about nothing at all.", "s2"),
    (7, "Überall ößterreichische Wörter – und 漢字 🙂, l'été s'en va; 3½ ١٢٣\u00a0\u2003x", "s2"),
    (7, "Überall ößterreichische Wörter – und 漢字 🙂, l'été s'en va; 3½ ١٢٣\u00a0\u2003x", "s2"),
    (None, "A row without an id, yet with some words in it for good measure.", "s1"),
    (9, "a" * 5000, None),
]


def odd_documents(spark):
    rows = [(i, t, None, s, None, "ids", None, "7", "row", "host", "0.5", "w", "g", "k", "no", "big", 3) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
