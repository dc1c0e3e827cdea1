"""Inputs that the registered queries derive from the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.htmltext import strip_html
from ..operators.line_rows import split_lines
from ..operators.search import corpus_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTENSIONS = ("md", "txt", "py", "json", "html", "cs")


def doc_path(extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    ext = F.get(F.array(*map(F.lit, extensions)), (F.col("doc_id") % len(extensions)).cast("int"))
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), ext)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as files."""
    mtime = F.lit(1704067200) + F.col("doc_id") * 3600
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        doc_path().alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.timestamp_seconds(mtime).alias("modified"),
        "text",
    )


VFILES = """vfiles AS (
  SELECT doc_id,
         source || '/' || lang || '/doc' || doc_id || '.'
           || ['md','txt','py','json','html','cs'][(doc_id % 6)::INT + 1] AS path,
         strlen(text)::BIGINT AS length, 1704067200 + doc_id * 3600 AS mtime_s, text
  FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"))


VLINES = """vlines AS (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::BIGINT AS idx,
         unnest(string_split(text, chr(10))) AS line
  FROM documents)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each line with their position ``k``."""
    rows = lines(spark, sf_dir).select(
        "doc_id", F.col("idx").alias("para"), F.posexplode(F.split("line", " ", -1)).alias("k", "word")
    )
    return rows.withColumn("k", F.col("k").cast("bigint"))


VWORDS = f"""{VLINES},
vwords AS (
  SELECT doc_id, idx AS para, unnest(generate_series(0, len(string_split(line, ' ')) - 1))::BIGINT AS k,
         unnest(string_split(line, ' ')) AS word
  FROM vlines)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as a log of commands."""
    odd = F.col("event_id") % 2 == 1
    script = F.when(odd, F.concat("event_type", F.lit("\n"), "props", F.lit(" \n"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        "event_type",
        script.alias("script"),
        F.concat("props", F.lit("\n"), F.repeat(F.lit("`"), (F.col("event_id") % 6).cast("int")), F.lit("\n ")).alias("output"),
        (F.col("event_id") % 3).cast("int").alias("exit_code"),
    )


VCMD = """vcmd AS (
  SELECT event_id AS run_id, event_type,
         CASE WHEN event_id % 2 = 1 THEN event_type || chr(10) || props || ' ' || chr(10) ELSE event_type END AS script,
         props || chr(10) || repeat('`', event_id % 6) || chr(10) || ' ' AS output,
         (event_id % 3)::INT AS exit_code
  FROM events)"""


HIT_QUERIES = ("the ", "le ", "der ", "no such words anywhere")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three short queries over all pages, every hit twice."""
    pages = table(spark, sf_dir, "pages")
    found = F.array_compact(F.array(*(F.when(F.col("html").contains(q), F.lit(q)) for q in HIT_QUERIES)))
    copies = F.explode(F.sequence(F.lit(0), F.lit(1)))
    rows = pages.select("page_id", "url", F.explode(found).alias("query")).withColumn("copy", copies)
    return rows.select("query", (F.col("page_id") * 2 + F.col("copy")).alias("pos"), "url")


VHITS = """vhits AS (
  SELECT query, page_id * 2 + copy AS pos, url
  FROM pages, (VALUES ('the '), ('le '), ('der '), ('no such words anywhere')) q(query), (VALUES (0), (1)) c(copy)
  WHERE contains(html, query))"""


TERM_QUERIES = ("Nation the", "le de", "der die das", "no such words anywhere")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their ``text``, in which tags and attributes are no hits."""
    return table(spark, sf_dir, "pages").withColumn("text", strip_html(F.col("html")))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_search(page_text(spark, sf_dir), TERM_QUERIES, "text")


# Over ``collapsed (page_id, text)``, the text of pages.
VSEARCHED = """terms AS (
  SELECT query, unnest(string_split(lower(query), ' ')) AS term
  FROM (VALUES ('Nation the'), ('le de'), ('der die das'), ('no such words anywhere')) q(query)),
lowered AS (SELECT page_id, lower(text) AS body FROM collapsed),
vsearched AS (
  SELECT query, page_id, url
  FROM (SELECT query, page_id, url FROM pages JOIN lowered USING (page_id), terms GROUP BY query, page_id, url
        HAVING bool_and(contains(body, term))))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs in lists of four; some have lost their scheme, so some lists hold bad URLs."""
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select(
        F.expr("page_id div 4").alias("request"),
        F.col("page_id").alias("ord"),
        F.when(F.col("page_id") % 7 >= 5, bare).otherwise(F.col("url")).alias("url"),
    )


VREQUESTS = """vrequests AS (
  SELECT page_id // 4 AS request, page_id AS ord,
         CASE WHEN page_id % 7 >= 5 THEN regexp_replace(url, '^https?://', '') ELSE url END AS url
  FROM pages)"""
