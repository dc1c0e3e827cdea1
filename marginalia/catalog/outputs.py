"""Registered queries: sinks and streams, read back after writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks
from ..session import is_folder, work_folder
from ..streaming import grep
from ..streaming.lines import stream_lines as search_lines
from . import inputs
from .lines import _KEPT, PLAIN, SPEC, _pieces, _report
from .registry import query

TIME = "1704067200000"
STAMP = "20240101000000"


@query(
    f"""WITH {inputs.VFILES}
SELECT regexp_replace(path, '\\.[a-z]+$', '') || '-output.md' AS out_path, text AS content FROM vfiles"""
)
def save_per_item(spark, sf_dir):
    items = sinks.output_paths(inputs.files(spark, sf_dir), sinks.FILE_TEMPLATE, STAMP, TIME)
    folder = work_folder(spark, "per-item")
    sinks.save_per_item(items.withColumn("content", F.col("text")), folder)
    return spark.read.parquet(folder)


@query(f"WITH {inputs.VLINES} SELECT line AS value FROM vlines")
def save_combined(spark, sf_dir):
    folder = work_folder(spark, "combined")
    items = inputs.table(spark, sf_dir, "documents")
    sinks.save_combined(items, folder, ["doc_id"], "text")
    return spark.read.text(folder)


@query(f"WITH {inputs.VLINES} SELECT line AS value FROM vlines")
def save_report(spark, sf_dir):
    """All documents in order in one file, read back line by line; tests compare the file byte for byte."""
    target = f"{work_folder(spark, 'report')}/all.md"
    sinks.save_report(inputs.table(spark, sf_dir, "documents"), target, ["doc_id"], "text")
    return spark.read.text(target)


@query("SELECT conv_id, role, text AS content FROM conversations")
def save_history(spark, sf_dir):
    folder = work_folder(spark, "history")
    target = sinks.save_history(inputs.table(spark, sf_dir, "conversations"), folder, TIME)
    return spark.read.schema("conv_id bigint, role string, content string").json(target)


@query(
    """WITH named AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(url, '^https?://|#.*$', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-') AS slug FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY md5(url), page_id) AS n FROM named)
SELECT 'web-pages/' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS out_path, html AS content FROM placed"""
)
def save_pages(spark, sf_dir):
    folder = work_folder(spark, "pages")
    sinks.save_pages(inputs.table(spark, sf_dir, "pages"), folder, F.col("html"))
    return spark.read.parquet(folder)


@query(
    """WITH named AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(url, '^https?://|#.*$', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-') AS slug FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY md5(url), page_id) AS n FROM named)
SELECT 'web-pages/' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '-output.md' AS out_path, html AS content FROM placed"""
)
def save_page_outputs(spark, sf_dir):
    """Page outputs under a template of the page's name."""
    folder = work_folder(spark, "page-outputs")
    pages = inputs.table(spark, sf_dir, "pages")
    sinks.save_pages(pages, folder, F.col("html"), template=sinks.PAGE_TEMPLATE, timestamp=STAMP, time=TIME)
    return spark.read.parquet(folder)


def _arriving(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "documents").schema
    table = f"{sf_dir}/documents.parquet"  # one file, or a folder of files
    if is_folder(spark, table):
        documents = grep.read_documents(spark, table, schema)
    else:
        documents = grep.read_documents(spark, sf_dir, schema, "documents.parquet")
    return documents.withColumn("path", inputs.doc_path(("txt",)))


@query(_report(True))
def stream_grep(spark, sf_dir):
    folder = work_folder(spark, "stream-grep")
    rows = grep.stream_grep(_arriving(spark, sf_dir), SPEC).select("doc_id", "report")
    grep.run_to_parquet(rows, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query(
    f"""SELECT source || '/' || lang || '/doc' || doc_id || '.out' AS out_path, report AS content
FROM ({_report(False)}) JOIN documents USING (doc_id)"""
)
def stream_save(spark, sf_dir):
    folder = work_folder(spark, "stream-save")
    rows = grep.stream_grep(_arriving(spark, sf_dir), PLAIN)
    grep.stream_save(rows, f"{folder}/out", f"{folder}/checkpoint", "{filePath}/{fileBase}.out", STAMP, TIME)
    return spark.read.schema("out_path string, content string").parquet(f"{folder}/out/batch=*")


@query(
    """WITH placed AS (SELECT source || '/' || lang AS base, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
SELECT base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.out' AS out_path FROM placed"""
)
def stream_save_repeats(spark, sf_dir):
    """Arriving documents that share output paths get a number each, over all batches."""
    folder = work_folder(spark, "stream-repeats")
    rows = _arriving(spark, sf_dir).withColumn("path", F.concat("source", F.lit("/"), "lang", F.lit(".txt")))
    reports = rows.select("path", F.col("text").alias("report"))
    grep.stream_save(reports, f"{folder}/out", f"{folder}/checkpoint", "{filePath}/{fileBase}.out", STAMP, TIME, on_repeat="number")
    return spark.read.schema("out_path string, content string").parquet(f"{folder}/out/batch=*").select("out_path")


@query(f"WITH {_KEPT}, {_pieces(True, chr(39) + '```' + chr(39))} SELECT doc_id, idx, piece, out FROM pieces")
def stream_lines(spark, sf_dir):
    """Lines that arrive in three batches, out of order, searched with context over the batches."""
    folder = work_folder(spark, "stream-lines")
    lines = inputs.lines(spark, sf_dir)
    for turn in range(3):
        some = lines.filter((F.col("idx") * 7 + F.col("doc_id")) % 3 == turn)
        some.write.mode("append").parquet(f"{folder}/in")
        arriving = grep.read_documents(spark, f"{folder}/in", lines.schema)
        grep.run_to_parquet(search_lines(arriving, SPEC), f"{folder}/rows", f"{folder}/checkpoint", versions=0)
    return spark.read.schema("doc_id bigint, idx bigint, piece int, out string").parquet(f"{folder}/rows")
