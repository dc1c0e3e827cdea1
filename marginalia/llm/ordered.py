"""Running sums over a whole table in a given order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def running_sum(rows: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to and including each, in ``order``.

    Rows are dealt out by ranges of the order, summed within their range, and the totals of the earlier ranges are
    added; there are as many totals as partitions. The ranges are written to the shared folder, so that a recomputed
    task cannot deal them out differently. Rows equal in ``order`` come in any order, so let it end with what tells
    rows apart.
    """
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__value", value)
    kept = materialize(dealt, "ranges")
    totals = dict(map(tuple, kept.groupBy("__part").agg(F.sum("__value").alias("n")).collect()))
    before, start = [], 0
    for part in range(max(totals, default=0) + 1):
        before.append(F.lit(start).cast("bigint"))
        start += totals.get(part, 0)
    base = F.get(F.array(*before), F.col("__part"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn(name, (F.sum("__value").over(own) + base).cast("bigint")).drop("__part", "__value")
