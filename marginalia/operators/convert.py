"""Converters for binary content, plugged in by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Converter = Callable[[str, bytes], str]


def converter_key(path: Column, converters: Mapping[str, Converter]) -> Column:
    """The first registered suffix the name ends with, in any case; null when there is none."""
    lowered, key = F.lower(path), None
    for suffix in converters:
        takes = lowered.endswith(F.lit(suffix.lower()))
        key = F.when(takes, F.lit(suffix)) if key is None else key.when(takes, F.lit(suffix))
    return F.lit(None).cast("string") if key is None else key


def convert_dispatch(
    files: DataFrame,
    converters: Mapping[str, Converter],
    content: str = "content",
    name: str = "text",
    error: str = "error",
) -> DataFrame:
    """Markdown of each file by the first converter that accepts its name, empty without one.

    A converter that raises fails its file only: the message goes to ``error``, the text stays null. Content
    crosses into Python only for rows that have a converter.
    """
    registry = dict(converters)

    def attempt(key: str | None, path: str, given: bytes | None) -> tuple[str | None, str | None]:
        if key is None or given is None:
            return None, None
        try:
            return registry[key](path, bytes(given)), None
        except Exception as caught:
            return None, str(caught)

    @F.pandas_udf("text string, error string")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield pd.DataFrame([attempt(*row) for row in zip(*columns)], columns=["text", "error"], dtype=object)

    routed = files.withColumn("__key", converter_key(F.col("path"), registry))
    given = F.when(F.col("__key").isNotNull(), F.col(content))
    done = routed.withColumn("__done", convert(F.col("__key"), F.col("path"), given))
    failed = F.col("__done.error")
    earlier = F.col(error) if error in files.columns else F.lit(None).cast("string")
    return (
        done.withColumn(name, F.when(failed.isNull(), F.coalesce(F.col("__done.text"), F.lit(""))))
        .withColumn(error, F.coalesce(earlier, failed))
        .drop("__key", "__done")
    )
