"""Queries over conversations."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialogue_repair import repair, turns_digest
from .registry import query, table

SPACE = " "
KINDS = 20
DROPPED, EMPTIED, OPENED, REPEATED, RECAST = range(5)
NOTHING = sha256(b"").hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """Turns as the checksum of their id and number has them: lost, emptied, without full stops, said twice or by the user."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(SPACE))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % KINDS
    marked = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    left = marked.filter(F.col("kind") != DROPPED)
    text = F.when(F.col("kind") == EMPTIED, F.lit("")).when(F.col("kind") == OPENED, F.regexp_replace("text", "[.!?]", ""))
    role = F.when(F.col("kind") == RECAST, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == REPEATED, 2).otherwise(1)))
    changed = left.select("conv_id", "turn", role.alias("role"), text.otherwise(F.col("text")).alias("text"), times.alias("time"))
    return changed.drop("time")


@query()
def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, after damage to its turns."""
    given = table(spark, sf_dir, "conversations")
    verdicts, turns = repair(damage(given))
    digests = turns_digest(turns)
    asked = given.select("conv_id").distinct()
    same = lambda rows: asked_id.eqNullSafe(rows["conv"])
    asked_id = asked["conv_id"]
    joined = asked.join(verdicts, same(verdicts), "left").drop("conv").join(digests, same(digests), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(NOTHING)).alias("repaired_sha256")
    )
