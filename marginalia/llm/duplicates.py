"""Queries over near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .simhash import near_duplicates


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    judged = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return judged.select("doc_id", shown.alias("fingerprint"), F.col("component").alias("component_id"))
