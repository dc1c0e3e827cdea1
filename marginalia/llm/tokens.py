"""Queries over the tokenizer operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_reuse
from .byte_bpe import encode, read_ranks
from .registry import query, table
from .token_counts import count_tokens, read_model

TOKEN_LIMIT = 1024


def bpe_digests(docs: DataFrame, rank_path: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes for each document."""
    coded = encode(docs.select("doc_id", "text"), read_ranks(rank_path), ids="ids", decoded="decoded")
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level ranks and decoded again."""
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds a context of 1,024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, read_model(public_tokenizers.path("byte_bpe_50k.json")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query()
def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word-level model, chunks that documents share only once, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = chunk_reuse.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    coded = chunk_reuse.encode(docs, model, ids="ids", decoded="decoded", keep_text=False)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
