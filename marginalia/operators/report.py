"""Outputs of items and commands put together in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_keys
from .ordered import sum_before

PART_BYTES = 1 << 20
SLICE_ITEMS = 1000
PREFIX = 256


def union_commands(*outputs: DataFrame) -> DataFrame:
    """Outputs of several commands one after the other, with the ordinal of the command."""
    whole = None
    for i, rows in enumerate(outputs):
        rows = rows.withColumn("cmd", F.lit(i))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def combined_output(
    items: DataFrame,
    keys: Sequence[str],
    order: str = "ord",
    out: str = "out",
    part_bytes: int = PART_BYTES,
    slice_items: int = SLICE_ITEMS,
) -> DataFrame:
    """Newline-joined item outputs, as parts ``(keys, part, piece, text)``.

    The parts of a report in the order of ``part`` and ``piece``, joined by newlines, are the combined output. A part is
    a stretch of ``slice_items`` ordinals, so a report of any size is joined by many tasks. Within it a new piece
    begins with every ``part_bytes`` bytes, so a piece holds that much and one item, also where few items are huge or
    many share an ordinal; items of one ordinal come in the order of their text.

    Parts of fewer bytes are one piece, so their texts are shuffled once, to be joined. Only for longer parts are the
    bytes summed over ranges of the order, so items of one ordinal are dealt to many tasks too; only a piece is gathered.
    """
    part = [*keys, "part"]
    needed = list(dict.fromkeys([*part, order, out]))
    sliced = items.withColumn("part", F.expr(f"{order} div {slice_items}")).select(*needed)
    sized = materialize(sliced.withColumn("__size", F.octet_length(out) + 1), "items")
    totals = sized.groupBy(*part).agg(F.sum("__size").alias("__bytes"))
    longer = materialize(totals.filter(F.col("__bytes") >= part_bytes).select(*part), "longer")
    single = join_keys(sized, longer, part, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    several, start = join_keys(sized, longer, part, "left_semi"), [order, F.left(F.col(out), F.lit(PREFIX))]
    placed = sum_before(several, part, [order, out], F.col("__size"), "__before", deal=start)
    cut = placed.withColumn("piece", F.floor(F.col("__before") / part_bytes).cast("bigint"))
    pieces = single.select(*needed, "piece").unionByName(cut.select(*needed, "piece"))
    text = F.transform(F.sort_array(F.collect_list(F.struct(order, out))), lambda s: s[out])
    return pieces.groupBy(*part, "piece").agg(F.array_join(text, "\n").alias("text"))


def bounded_pieces(items: DataFrame, keys: Sequence[str], order: str, out: str, limit: int) -> DataFrame:
    """Newline-joined item outputs as pieces ``(keys, piece, text)`` of ``limit`` bytes at most, numbered from 0.

    Items longer than a quarter of half the limit are cut into stretches, which are joined again without a newline. A piece
    begins with the first stretch behind every half of the limit, and no stretch is longer than that half, so numbers have
    no gaps. Items of one ordinal come in the order of their first characters, then of their digests. Null outputs are
    left out, as they are when outputs are joined.
    """
    step = limit // 2
    stretch = (step - 1) // 4  # a character has four bytes at most
    if stretch < 1:
        raise ValueError("pieces need ten bytes at least")
    given = items.filter(F.col(out).isNotNull()).select(
        *keys,
        F.col(order).alias("__ord"),
        F.left(F.col(out), F.lit(PREFIX)).alias("__prefix"),
        F.sha2(F.col(out).cast("binary"), 256).alias("__digest"),
        F.monotonically_increasing_id().alias("__item"),
        F.col(out).alias("__out"),
    )
    length = F.length("__out")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / stretch)).cast("int"))
    cut = materialize(given, "items").withColumn("__nth", F.explode(starts))
    text = F.substring(F.col("__out"), F.col("__nth") * stretch + 1, F.lit(stretch))
    own = F.when(F.col("__nth") == 0, F.concat(F.lit("\n"), text)).otherwise(text)
    rows = cut.withColumn("__text", own).drop("__out")
    places = ["__ord", "__prefix", "__digest", "__item", "__nth"]
    placed = sum_before(rows, keys, places, F.octet_length("__text"), "__before")
    numbered = placed.withColumn("piece", F.floor(F.col("__before") / step).cast("bigint"))
    parts = F.sort_array(F.collect_list(F.struct("__before", "__nth", "__text")))
    pieces = numbered.groupBy(*keys, "piece").agg(parts.alias("__parts"))
    joined = F.array_join(F.transform("__parts", lambda p: p["__text"]), "")
    whole = F.get("__parts", F.lit(0))["__nth"] == 0  # else it begins within an item, and with a stretch of that
    return pieces.select(*keys, "piece", F.when(whole, F.substring(joined, F.lit(2), F.length(joined))).otherwise(joined).alias("text"))
