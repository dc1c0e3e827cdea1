"""Words and lines as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def count_chars(text: Column, one: str) -> Column:
    """How many characters of ``text`` match the one-character pattern ``one``; 0 for null."""
    return F.coalesce(F.length(text) - F.length(without(text, one)), F.lit(0)).cast("bigint")
