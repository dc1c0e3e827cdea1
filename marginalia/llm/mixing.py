"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a number of words. Whole epochs come first; the rest is drawn by Efraimidis and Spirakis: a document
of weight w has the key -ln(u) / w with u uniform, the documents with the smallest keys are taken until their words
reach the budget. u is a digest of the document's id, so reruns agree. Rows that share id and weight follow each other
by size, digest of the text and number of the row, so the cut can go between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_keys
from ..session import materialize
from .ordered import running_sum
from .text import count_chars, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
#: What tells the rows of a source apart in the draw; rows equal in it are copies.
PLACE = ("key", "id", "size", "tie")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Share of words among words and symbols such as ``#`` or ``$``; 1 without words."""
    n = word_count(text)
    return F.when(n > 0, n / (n + count_chars(text, "[#*$%&|<>]"))).otherwise(F.lit(1.0))


def sampling_key(identity: Column, weight: Column, seed: str = SEED) -> Column:
    """An exponential variable with rate ``weight``, from 52 bits of a digest of the identity; smaller is drawn earlier."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def _targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``sources`` with ``target``: words by weight, stopped at ``most`` times the source, the excess reshared.

    Each round adds the sources that reach their stop to those that keep it; only sums come to the driver.
    """
    stop = (most * F.col("source_size")).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= stop
        n, used, free = sources.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, stop).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - used) / free
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), stop) if free else stop)


def plan_mix(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``epochs`` and ``cutoff``.

    ``rows`` has ``id``, ``source``, ``size`` (words), ``key``, ``tie`` and ``row_id``. Sources in code point order,
    null last, have the given weights in turn. A document is taken ``epochs`` times, and once more if its place
    (``PLACE`` and ``row_id``) is not after ``cutoff``.
    The cut is where the words drawn come nearest to what the target leaves beyond whole epochs.
    """
    order = ["missing", "source"]
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    numbered = running_sum(sized, order, F.lit(1), "place")
    turn = F.array(*map(F.lit, weights))
    weighted = numbered.withColumn("weight", F.get(turn, ((F.col("place") - 1) % len(weights)).cast("int")))
    started = running_sum(weighted, order, F.col("source_size"), "upto").withColumn("start", F.col("upto") - F.col("source_size"))
    targets = _targets(started, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    planned = materialize(
        targets.withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest", "start"),
        "targets",
    )
    drawn = running_sum(rows.withColumn("missing", F.col("source").isNull()), [*order, *PLACE, "row_id"], F.col("size"), "upto")
    placed = join_keys(drawn, planned.select("source", "rest", "start"), ["source"])
    middle = F.col("upto") - F.col("start") - F.col("size") / 2
    last = (
        placed.filter((F.col("size") > 0) & (F.col("rest") > 0) & (middle <= F.col("rest")))
        .groupBy("source")
        .agg(F.max(F.struct(*PLACE, "row_id")).alias("cutoff"))
    )
    return materialize(join_keys(planned, last, ["source"], "left").drop("rest", "start"), "mix")


def copies(drawn: Column) -> Column:
    """How often a document is taken, beside the columns of ``plan_mix``."""
    return F.col("epochs") + F.coalesce((F.col("size") > 0) & drawn, F.lit(False)).cast("bigint")


def measures(body: Column, identity: Column) -> list[Column]:
    """The columns of ``PLACE``."""
    key = sampling_key(identity, quality_weight(body))
    return [key.alias("key"), identity.alias("id"), word_count(body).alias("size"), F.xxhash64(body).alias("tie")]


def measured(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``PLACE``, ``source`` and ``row_id`` of each row; to be written, as a second pass may number rows differently."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        *measures(body, F.col(key)), F.col(source).alias("source"), F.monotonically_increasing_id().alias("row_id")
    )


def _at_cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``alike``, the copies among which a source's cut goes, and ``drawn``, how many of them it draws."""
    last = F.struct(*[F.col(f"cutoff.{c}") for c in PLACE])
    joined = join_keys(rows, plan.select("source", "cutoff"), ["source"]).filter(F.struct(*PLACE) == last)
    before = F.count(F.when(F.col("row_id") <= F.col("cutoff.row_id"), 1))
    counted = joined.groupBy("source").agg(F.count(F.lit(1)).alias("alike"), before.alias("drawn"))
    return materialize(join_keys(plan, counted, ["source"], "left"), "mix")


def _some_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: whether a row is among the ``drawn`` first of its source.

    ``plan`` has the sources of ``rows`` with ``alike``, their number. Rows are numbered by their source and number
    alone; only the last number drawn, one row per source, is joined to them.
    """
    kept = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "copies")
    upto = running_sum(plan.select("source", "alike", "drawn"), ["source"], F.col("alike"), "upto")
    starts = upto.select("source", "drawn", (F.col("upto") - F.col("alike")).alias("start"))
    placed = running_sum(kept.select("source", "number"), ["source", "number"], F.lit(1), "place")
    first = join_keys(placed, starts, ["source"]).filter(F.col("place") - F.col("start") <= F.col("drawn"))
    last = materialize(first.groupBy("source").agg(F.max("number").alias("last")), "last")
    return join_keys(kept, last, ["source"], "left").withColumn("taken", F.coalesce(F.col("number") <= F.col("last"), F.lit(False)))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Texts are read once. A null or empty text has no words; a source without words has target 0 and none of its
    documents is taken. Repeated rows are documents of their own, also in the draw. The null source is a source of its
    own; an empty table gives no rows.

    Sizes are summed before they are shuffled. The draw is one sort over all documents by source, key and row, dealt
    out by ranges, so a hot source or id is spread over many tasks.
    """
    rows = materialize(measured(docs, key, text, source), "sizes")
    joined = join_keys(rows, plan_mix(rows), ["source"])
    taken = joined.withColumn("copies", copies(F.struct(*PLACE, "row_id") <= F.col("cutoff")))
    return taken.select(
        "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Only the plan, one row per source, is joined to the documents, so texts are not shuffled while it is small. Where a
    cut goes between copies, just these rows are written and numbered, as any of them are as good.
    """
    sizes = materialize(measured(docs, key, text, source), "sizes")
    plan = _at_cut(sizes, plan_mix(sizes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("row"), F.col(source).alias("source"))
    body, identity = F.coalesce(F.col(f"row.`{text}`"), F.lit("")), F.col(f"row.`{key}`")
    joined = join_keys(carried, plan, ["source"]).select("*", *measures(body, identity))
    at, last = F.struct(*PLACE), F.struct(*[F.col(f"cutoff.{c}") for c in PLACE])
    parted = F.col("drawn") < F.col("alike")
    split = plan.filter(parted)
    taken = joined.withColumn("n", copies(at <= last))
    if not split.isEmpty():
        among = F.coalesce((at == last) & parted, F.lit(False))
        some = _some_of(joined.filter(among).select("row", "source", "epochs", "size"), split)
        taken = taken.filter(~among).select("row", "n").union(some.select("row", copies(F.col("taken")).alias("n")))
    chosen = taken.filter("n > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
