"""Recorded commands as blocks, combined per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import run_block, run_error_block
from ..operators.report import combined_output


def run_blocks(run_log: DataFrame) -> DataFrame:
    """Rows ``(run_id, script, output, exit_code)`` with their block in ``out``.

    Where the log has an ``error``, a command that could not be run at all shows that instead.
    """
    block = run_block(F.col("script"), F.col("output"), F.col("exit_code"))
    if "error" in run_log.columns:
        failed = run_error_block(F.col("script"), F.col("error"), F.lit(""))
        block = F.when(F.col("error").isNotNull(), failed).otherwise(block)
    return run_log.withColumn("out", block)


def run_report(run_log: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return combined_output(run_blocks(run_log), keys, "run_id", "out", **options)
