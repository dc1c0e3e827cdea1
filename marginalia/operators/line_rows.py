"""The line search on one row per line, for inputs that arrive that way or documents too long for a row.

Rows are ``(doc_id, idx, line)`` with ``idx`` dense from 0. Windows run over fixed stretches of a document,
each with a few borrowed rows at its edges, so a document of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import line_hit, matches_any
from ..spec import LineSpec
from .lines import _shown, gap_separator, split_array
from .numbering import running_count

STRETCH = 1 << 16


def split_lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    lines = F.posexplode(split_array(F.col(text))).alias("idx", "line")
    return docs.select(*keys, lines).withColumn("idx", F.col("idx").cast("bigint"))


def matching_rows(lines: DataFrame, spec: LineSpec) -> DataFrame:
    """Lines that match every include pattern and no remove pattern; a plain row filter."""
    return lines.filter(line_hit(F.col("line"), spec.include, spec.remove))


def context_lines(
    lines: DataFrame, spec: LineSpec, keys: Sequence[str] = ("doc_id",), stretch: int = STRETCH
) -> DataFrame:
    """Kept lines with ``hit``, ``starts`` (first line of an unbroken run of kept lines) and their ``stretch``."""
    flagged = lines.withColumn("hit", line_hit(F.col("line"), spec.include, spec.remove))
    if not spec.has_context:
        kept = flagged.filter("hit").withColumn("starts", F.lit(False))
        return kept.withColumn("stretch", F.expr(f"idx div {stretch}"))
    left, right = spec.after + 1, spec.before
    stretch = max(stretch, left + right)
    offset, own = F.col("idx") % stretch, F.expr(f"idx div {stretch}")
    homes = F.array_compact(
        F.array(
            own,
            F.when(offset >= stretch - left, own + 1),
            F.when((offset < right) & (own > 0), own - 1),
        )
    )
    spread = flagged.withColumn("__own", own).withColumn("__part", F.explode(homes))
    spread = spread.withColumn("line", F.when(F.col("__part") == F.col("__own"), F.col("line")))
    order = Window.partitionBy(*keys, "__part").orderBy("idx")
    near = F.max(F.col("hit").cast("int")).over(order.rowsBetween(-spec.after, spec.before))
    kept = spread.withColumn("__kept", near == 1)
    kept = kept.withColumn("__last", F.coalesce(F.lag("__kept").over(order), F.lit(False)))
    kept = kept.filter(F.col("__kept") & (F.col("__part") == F.col("__own")))
    kept = kept.withColumn("starts", ~F.col("__last")).withColumnRenamed("__part", "stretch")
    return kept.drop("__own", "__kept", "__last")


def gap_blocks(kept: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Number the unbroken runs of kept lines in each document, from 1.

    Counts within the stretches that ``context_lines`` made, on its partitioning.
    """
    return running_count(kept, keys, [F.col("idx")], "stretch", F.col("starts"), "block")


def mask_removed(kept: DataFrame, spec: LineSpec) -> DataFrame:
    """Context lines that match a remove pattern lose their text, or go when lines are not numbered."""
    gone = matches_any(F.col("line"), spec.remove)
    masked = kept.withColumn("removed", gone)
    if spec.numbers:
        return masked.withColumn("line", F.when(gone, F.lit(None)).otherwise(F.col("line")))
    return masked.filter(~F.col("removed"))


def grep_rows(
    lines: DataFrame,
    spec: LineSpec,
    keys: Sequence[str] = ("doc_id",),
    ticks: Column | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """Printed pieces of each document as rows ``(keys, idx, piece, out)``; in that order they are the report.

    ``piece`` 0 is a gap mark and 1 the line. Nothing is gathered per document.
    """
    kept = context_lines(lines, spec, keys, stretch)
    kept = gap_blocks(kept, keys) if spec.has_context else kept.withColumn("block", F.lit(1))
    return printed_rows(kept, spec, keys, ticks)


def printed_rows(kept: DataFrame, spec: LineSpec, keys: Sequence[str], ticks: Column | None = None) -> DataFrame:
    """What is printed for kept lines whose runs are numbered (``block``)."""
    ticks = F.lit("```") if ticks is None else ticks
    gap = F.col("starts") & (F.col("block") > 1)
    pieces = F.array(
        F.when(gap, gap_separator(ticks)), _shown(F.col("line"), F.col("idx"), spec)
    )
    out = kept.select(*keys, "idx", F.posexplode(pieces).alias("piece", "out"))
    return out.filter(F.col("out").isNotNull())
