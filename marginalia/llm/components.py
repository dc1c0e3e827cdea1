"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _towards_least(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with the least neighbour of ``a`` (or ``a`` itself) as ``least``.

    The least neighbour is aggregated before the shuffle, so a node with very many neighbours is no hot key there; the
    join back is an equi join that Spark can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("least"))
    return both.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    return _towards_least(edges).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)`` that is not the least node of its component.

    ``a`` and ``b`` are of one orderable type. Each round writes its edges to the shared folder, so the plan stays short
    and a lost executor costs one round; the rounds end when no edge changes. Loops and repeated edges are ignored,
    edges with a null end are dropped, and no edges give no rows.
    """
    clean = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = materialize(clean.distinct(), "edges"), None
    while True:
        signs = F.xxhash64("a", "b")
        seen = now.agg(F.count(F.lit(1)), F.sum(signs.cast("decimal(38,0)")), F.bit_xor(signs)).first()
        if not seen[0] or tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        stars = _small_star(_large_star(now).distinct())
        now = materialize(stars.filter(F.col("a") != F.col("b")).distinct(), "edges")
