"""Query over the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .rule_ensemble import RuleModel, fit, sampled, scored

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def quality_model(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Rules learnt from the labelled documents outside the held-out fold."""
    learnt = labels.filter(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "quality")
    return fit(sampled(docs.select("doc_id", "text"), learnt, "doc_id", "quality"), "text", "sample_label")


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by rules learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "text", F.col("doc_id")).select(
        F.col("row").alias("doc_id"),
        (fold(F.col("row")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
