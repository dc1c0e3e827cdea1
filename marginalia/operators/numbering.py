"""Row numbers and running counts that no single task has to produce for a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import join_keys

_BASE = "__base"


def _add_earlier(
    rows: DataFrame, totals: DataFrame, keys: Sequence[str], slice_by: str, local: str, name: str
) -> DataFrame:
    """``local`` numbers plus the totals of earlier slices; slices after nothing have no row to join."""
    before = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(_BASE, F.sum("__n").over(before)).filter(F.col(_BASE) > 0)
    joined = join_keys(rows, bases.select(*keys, slice_by, _BASE), [*keys, slice_by], "left")
    number = F.col(local) + F.coalesce(F.col(_BASE), F.lit(0))
    return joined.withColumn(name, number.cast("bigint")).drop(_BASE, local)


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column, name: str
) -> DataFrame:
    """``row_number()`` per key in the given order, starting at 1.

    ``slice_by`` cuts a key into bounded slices and must grow with ``order``. Each slice is numbered on its
    own; the counts of earlier slices, aggregated before they are shuffled, are added on top. A key that
    holds a third of all rows is therefore spread over many tasks. Rows are read twice, the first time for
    keys and order only; write out rows that are dear to compute before numbering them.
    """
    sliced = rows.withColumn("__slice", slice_by)
    totals = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    local = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    placed = sliced.withColumn("__local", local)
    return _add_earlier(placed, totals, keys, "__slice", "__local", name).drop("__slice")


def running_count(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: str, flag: Column, name: str
) -> DataFrame:
    """How many rows up to and including this one have ``flag`` set, per key in order.

    ``slice_by`` names a column that cuts keys into slices as above.
    """
    flagged = rows.withColumn("__flag", flag.cast("int"))
    totals = flagged.groupBy(*keys, slice_by).agg(F.sum("__flag").alias("__n"))
    upto = Window.partitionBy(*keys, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = flagged.withColumn("__local", F.sum("__flag").over(upto))
    return _add_earlier(placed, totals, keys, slice_by, "__local", name).drop("__flag")
