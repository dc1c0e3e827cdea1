"""Queries over shards and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import MAX_EPOCHS, SEED, SHARE, WEIGHTS, mix
from .registry import query, table
from .sharding import shard_documents


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; counts of shards differ by one at most."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / CASE WHEN size > 0 THEN size / (size + symbols) ELSE 1.0::DOUBLE END AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         {list(WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM k GROUP BY source),
c AS (
  SELECT *, {MAX_EPOCHS}::DOUBLE * source_size AS stop, row_number() OVER w AS place,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
l AS (
  SELECT *, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s)::BIGINT - used::BIGINT) / free::BIGINT AS level FROM c),
cut AS (
  SELECT min(place) AS place, min_by(level, place) AS level FROM l WHERE level * weight < stop),
t AS (
  SELECT source, source_size, CASE WHEN cut.place IS NULL OR l.place < cut.place THEN stop ELSE cut.level * weight END AS target
  FROM l, cut),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
placed AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
taken AS (
  SELECT *, epochs + (size > 0 AND rest > 0 AND upto - size / 2 <= rest)::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken"""


@query(MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's target."""
    taken = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
