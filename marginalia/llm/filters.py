"""Queries over the filters on documents and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filter_sql import QUALITY_SQL, url_sql
from .licenses import scan_licenses
from .quality_rules import judge
from .registry import query, table
from .url_templates import ALLOW, BLOCK, UrlRule, judge_urls

URL_RULES = (
    UrlRule(ALLOW, "org", "/"),
    UrlRule(BLOCK, "example.org", "/es/"),
    UrlRule(BLOCK, "example.org", "/en/1"),
    UrlRule(ALLOW, "com", "/fr/"),
    UrlRule(BLOCK, "com", "/de/"),
)


@query(QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, the base rules and the verdict with its host's share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = judge(docs, "text", "source", F.col("doc_id"))
    return judged.select(
        F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rejected", "kept",
    )


@query(url_sql(URL_RULES))
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by rules and path templates."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document, with their place and the share of the template that they cover."""
    return scan_licenses(table(spark, sf_dir, "documents"))
