"""Places, running sums and latest values in a given order, without one task that sees all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .joins import join_keys

#: ``monotonically_increasing_id`` holds the partition above this many bits and the place in it below them.
PLACE_BITS = 33


def _ranges(rows: DataFrame, order: Sequence[Column | str], deal: Sequence[Column | str] | None) -> DataFrame:
    """Rows dealt out by ranges of the order and sorted in them, with ``__part`` and ``__at``, the place in the part.

    They are written to the shared folder, so that a task that runs again cannot deal them out differently.
    """
    dealt = rows.repartitionByRange(*(deal or order)).sortWithinPartitions(*order)
    settled = materialize(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    place = F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    return settled.withColumns({"__part": F.shiftright("__id", PLACE_BITS), "__at": place}).drop("__id")


def _with_earlier(rows: DataFrame, totals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``__n`` over earlier parts; a key has as many totals as parts."""
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(name)
    others = [c for c in totals.columns if c not in (*keys, "__part", "__n")]
    return join_keys(rows, totals.select(*keys, "__part", *others, earlier), [*keys, "__part"])


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 among the rows of the same keys, in ``order``.

    The rows are shuffled once, by ranges of keys and order: let the order end with what tells rows apart, so that
    no key is too large for many ranges. Null keys are a key of their own; nulls come first in the order.
    """
    ranges = _ranges(rows, [*keys, *order], None)
    totals = ranges.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    joined = _with_earlier(ranges, totals, keys, "__base")
    place = (F.col("__base") + F.col("__at") - F.col("__first")).cast("bigint")
    return joined.withColumn(name, place).drop("__part", "__at", "__base", "__first")


def sum_before(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    name: str,
    deal: Sequence[Column | str] | None = None,
) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys before each, in ``order``.

    ``deal`` names shorter columns to deal the ranges by, where those of the order are long; it has to agree with the
    order. Rows equal in the order come in any order.
    """
    valued = rows.withColumn("__value", value)
    ranges = _ranges(valued, [*keys, *order], [*keys, *(deal or order)])
    totals = ranges.groupBy(*keys, "__part").agg(F.sum("__value").alias("__n"))
    own = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumn("__local", F.coalesce(F.sum("__value").over(own), F.lit(0)))
    joined = _with_earlier(local, totals, keys, "__base")
    total = (F.col("__base") + F.col("__local")).cast("bigint")
    return joined.withColumn(name, total).drop("__part", "__at", "__local", "__base", "__value")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before each, among the rows of the same keys in ``order``.

    The union of a table of states and a table of questions, in the order of their times, so becomes an as-of join in which
    a key with very many states or questions is many ranges.
    """
    ranges = _ranges(rows, [*keys, *order], None)
    upto = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.withColumn("__local", F.last(value, ignorenulls=True).over(upto))
    ends = ranges.filter(F.col(value).isNotNull()).groupBy(*keys, "__part").agg(F.max_by(value, "__at").alias("__end"))
    parts = join_keys(ranges.select(*keys, "__part").distinct(), ends, [*keys, "__part"], "left")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select(*keys, "__part", F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
    joined = join_keys(local, earlier.filter(F.col("__earlier").isNotNull()), [*keys, "__part"], "left")
    return joined.withColumn(name, F.coalesce("__local", "__earlier")).drop("__part", "__at", "__local", "__earlier")
