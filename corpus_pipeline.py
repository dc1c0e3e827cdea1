"""A training-data pipeline over documents: filter, deduplicate, mix and encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.classifier import THRESHOLD, quality_model
from marginalia.llm.mixing import mixed
from marginalia.llm.quality_rules import keep_good
from marginalia.llm.registry import table
from marginalia.llm.rule_ensemble import keep_scored
from marginalia.llm.simhash import drop_near_duplicates
from marginalia.llm.tokens import bpe_digests
from marginalia.session import materialize

RANKS = "byte_bpe_50k.tiktoken"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones, does not reject."""
    return keep_scored(docs, quality_model(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, a row for each copy in the mix."""
    return bpe_digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", deduplicate),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: A learnt classifier and the tokenizer's merges have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
