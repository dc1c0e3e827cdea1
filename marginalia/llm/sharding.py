"""Sharding by balanced label propagation, in DataFrame functions only.

Documents that share a group are linked. Every document starts in the shard that its id's hash names. Groups move as a
whole, the larger ones first, to the shard that holds most of them among those with room for all; this goes on until no
group that fits is left. A last step evens the shards out to equal counts, moving documents without links first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import running_sum

SHARDS = 16
PART = 0.8
#: Hubs above this part of a shard are placed by the driver; there are at most this many per shard.
LARGE = 64
#: Smaller hubs take turns by size, each turn down to this part of the one before.
STEP = 8


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    """The value of a shard; there are as many as shards."""
    return F.get(F.array(*[F.lit(values.get(s, 0)) for s in range(max(values, default=0) + 1)]), shard.cast("int"))


def _sizes(rows: DataFrame, shard: str) -> dict[int, int]:
    return {s: n for s, n in map(tuple, rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect())}


def _places(rows: DataFrame, shard: str, order: list[str], sizes: dict[int, int]) -> DataFrame:
    """``rows`` with ``place``, from 1, of each row within its shard."""
    starts, start = {}, 0
    for s in sorted(sizes):
        starts[s] = start
        start += sizes[s]
    counted = running_sum(rows, [shard, *order], F.lit(1), "place")
    return counted.withColumn("place", F.col("place") - _by_shard(starts, F.col(shard)))


def _hubs(rows: DataFrame, quota: int) -> DataFrame:
    """``rows`` with ``hub`` and ``hub_size``; documents with one hub are to stay together.

    A group that no shard can hold is cut by the hash of its rows into parts that fit; a document alone in its group
    has no hub.
    """
    groups = rows.filter(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    joined = rows.join(groups, "group", "left")
    parts = F.ceil(F.col("n") / F.lit(max(1.0, quota * PART)))
    hub = F.xxhash64("group", F.pmod(F.xxhash64("row_id"), parts))
    return joined.select("row_id", F.when(F.col("n") > 1, hub).alias("hub"), "shard")


def _place_large(hubs: DataFrame, rooms: dict[int, int], least: int) -> DataFrame:
    """``(hub, shard)`` of hubs above ``least`` rows; takes what they need from ``rooms``.

    The largest comes first and takes the shard it fills best. Its rows are spread evenly by their hash, so no shard
    holds much more of it than another. One that no shard has room for gets none.
    """
    rows = hubs.filter(F.col("hub_size") > least).select("hub", "hub_size").collect()
    placed = []
    for hub, size in sorted(map(tuple, rows), key=lambda row: (-row[1], row[0])):
        fits = [(room, s) for s, room in rooms.items() if room >= size]
        if fits:
            placed.append((hub, min(fits)[1]))
            rooms[placed[-1][1]] -= size
    return hubs.sparkSession.createDataFrame(placed, "hub long, shard int")


def _wishes(hubs: DataFrame, rooms: dict[int, int], turn: int) -> DataFrame:
    """``hubs`` that some shard has room for, with ``wish``: the one of these that holds most of it."""

    def of(s: int) -> Column:
        tie = F.xxhash64("hub", F.lit(s), F.lit(turn))
        return F.struct(F.get("held", F.lit(s)).alias("n"), tie.alias("tie"), F.lit(s).alias("shard"))

    open_ = F.array(*[F.when(F.col("hub_size") <= F.lit(room), of(s)) for s, room in rooms.items()])
    return hubs.withColumn("wish", F.array_max(open_)["shard"]).filter(F.col("wish").isNotNull())


def _asked(wished: DataFrame) -> dict[int, int]:
    return dict(map(tuple, wished.groupBy("wish").agg(F.sum("hub_size")).collect()))


def _place_small(hubs: DataFrame, rooms: dict[int, int], most: int) -> list[DataFrame]:
    """``(hub, shard)`` of hubs of ``most`` rows or fewer, in parts; takes what they need from ``rooms``.

    If all get what they wish, one pass does. Otherwise hubs take turns by size. In a turn each shard takes in hubs in
    the order of their size until the next does not fit, and those left wish again, until no shard has room for any.
    Every pass with a wish places a hub, as the first one always fits.
    """
    rest = hubs.filter(F.col("hub_size") <= most)
    wished = _wishes(rest, rooms, 0)
    asked = _asked(wished)
    if all(n <= rooms[s] for s, n in asked.items()) and wished.count() == rest.count():
        return [wished.select("hub", F.col("wish").alias("shard"))]
    parts, turn = [], 0
    while most > 0:
        waiting = hubs.filter((F.col("hub_size") <= most) & (F.col("hub_size") > most // STEP))
        while asked := _asked(wished := _wishes(waiting, rooms, turn)):
            starts, start = {}, 0
            for s in sorted(asked):
                starts[s] = start
                start += asked[s]
            summed = running_sum(wished.withColumn("smaller", -F.col("hub_size")), ["wish", "smaller", "hub"], F.col("hub_size"), "upto")
            fits = F.col("upto") - _by_shard(starts, F.col("wish")) <= _by_shard(rooms, F.col("wish"))
            judged = materialize(summed.select(*hubs.columns, "wish", fits.alias("fits")), "hubs")
            parts.append(judged.filter("fits").select("hub", F.col("wish").alias("shard")))
            for s, n in _asked(judged.filter("fits")).items():
                rooms[s] -= n
            waiting, turn = judged.filter("NOT fits").select(*hubs.columns), turn + 1
        most //= STEP
    return parts


def _even(now: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """``now`` with exactly the quotas: full shards give away, documents without links first, whole hubs never.

    ``kept`` tells the rows of hubs that are whole; a shard holds no more of these than its quota.
    """
    sizes = _sizes(now, "shard")
    excess = {s: max(0, sizes.get(s, 0) - quotas[s]) for s in quotas}
    ranked = _places(now.withColumn("linked", F.col("hub").isNotNull()), "shard", ["kept", "linked", "hub", "row_id"], sizes)
    before, start = {}, 0
    for s in sorted(excess):
        before[s] = start
        start += excess[s]
    leaves = F.col("place") <= _by_shard(excess, F.col("shard"))
    number = F.col("place") + _by_shard(before, F.col("shard"))
    target, start = F.lit(None).cast("int"), 0
    for s in sorted(quotas):
        room = max(0, quotas[s] - sizes.get(s, 0))
        target = F.when((number > start) & (number <= start + room), F.lit(s)).otherwise(target)
        start += room
    return ranked.select("row_id", "hub", F.when(leaves, target).otherwise(F.col("shard")).alias("shard"))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row_id``, ``shard`` (int from 0) and ``slot`` (gapless from 0 within the shard) of each row.

    ``rows`` has ``row_id`` (different longs) and ``group`` (documents with one group are linked, a null links none).
    Counts of shards differ by one at most. A hub is split only if no shard had room for it in its turn. An empty
    table gives no rows.

    Rooms are dealt out to hubs, one row each with its members per shard, counted before any shuffle; rows move once.
    Only counts per shard and a bounded number of large hubs come to the driver. Each step is written to the shared
    folder, so plans stay short and a lost executor costs one step; places are counted over ranges, never for a whole
    shard in one task.
    """
    start = materialize(rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int")), "start")
    total = start.count()
    quotas = {s: total // shards + (s < total % shards) for s in range(shards)}
    placed = materialize(_hubs(start, min(quotas.values())), "shards")
    linked = placed.filter(F.col("hub").isNotNull())
    held = F.array(*[F.sum((F.col("shard") == s).cast("bigint")) for s in range(shards)])
    hubs = materialize(linked.groupBy("hub").agg(F.count(F.lit(1)).alias("hub_size"), held.alias("held")), "hubs")
    rooms, least = dict(quotas), min(quotas.values()) // LARGE
    chosen = _place_large(hubs, rooms, least)
    for part in _place_small(hubs, rooms, least):
        chosen = chosen.union(part)
    chosen = materialize(chosen.withColumnRenamed("shard", "home"), "homes")
    moved = linked.join(chosen, "hub", "left").select(
        "row_id", "hub", F.coalesce("home", "shard").alias("shard"), F.col("home").isNotNull().alias("kept")
    )
    single = placed.filter(F.col("hub").isNull()).select("row_id", "hub", "shard", F.lit(False).alias("kept"))
    even = materialize(_even(materialize(single.union(moved), "moved"), quotas), "even")
    numbered = _places(even, "shard", ["hub", "row_id"], _sizes(even, "shard"))
    return numbered.select("row_id", "shard", (F.col("place") - 1).alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: ``key``, ``size``, ``text_crc32``, ``shard`` and ``slot``; equal texts are linked.

    Size is the text's UTF-8 bytes plus 1; a null text has none and is linked to empty ones. Every row is a document
    of its own, also if it repeats another or has no key. Texts are read once.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(key).alias("key"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("group"),
        ),
        "sizes",
    )
    placed = assign(sized.select("row_id", "group"), shards)
    return sized.join(placed, "row_id").select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")
