"""Registered queries: lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.markdown import fence
from ..operators import line_rows
from ..operators.lines import grep_report as report
from ..operators.lines import matching_lines, number_lines, split_array
from ..spec import LineSpec
from . import inputs
from .registry import query

SPEC = LineSpec(include=("ing ",), remove=("the",), before=1, after=2, numbers=True)
PLAIN = LineSpec(include=("ing ",), remove=("the",), before=1, after=2)
BOTH = LineSpec(include=("tion", "(?i)^the"))

_HIT = "contains(line, 'ing ') AND NOT contains(line, 'the')"
_KEPT = f"""{inputs.VLINES},
flagged AS (SELECT *, ({_HIT}) AS hit, contains(line, 'the') AS removed FROM vlines),
near AS (
  SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n
  FROM flagged),
kept AS (
  SELECT doc_id, idx, line, hit, removed, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS last_idx
  FROM near WHERE n = 1),
blocks AS (
  SELECT *, coalesce(idx > last_idx + 1, true) AS starts,
         sum(coalesce(idx > last_idx + 1, true)::INT) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS block
  FROM kept)"""


def _pieces(numbers: bool, ticks: str) -> str:
    shown = (
        "CASE WHEN removed THEN (idx + 1) || ':' ELSE (idx + 1) || ': ' || line END"
        if numbers
        else "CASE WHEN NOT removed THEN line END"
    )
    return f"""pieces AS (
  SELECT doc_id, idx, 0 AS piece, {ticks} || chr(10) || chr(10) || {ticks} AS out FROM blocks WHERE starts AND block > 1
  UNION ALL
  SELECT doc_id, idx, 1, {shown} FROM blocks)"""


def _report(numbers: bool) -> str:
    return f"""WITH {_KEPT}, {_pieces(numbers, "'```'")},
joined AS (SELECT doc_id, string_agg(out, chr(10) ORDER BY idx, piece) AS report FROM pieces WHERE out IS NOT NULL GROUP BY 1)
SELECT doc_id, coalesce(report, '') AS report FROM documents LEFT JOIN joined USING (doc_id)"""


@query(f"WITH {inputs.VLINES} SELECT doc_id, idx, line FROM vlines")
def split_lines(spark, sf_dir):
    return inputs.lines(spark, sf_dir)


@query(
    f"""WITH {inputs.VLINES}
SELECT doc_id, string_agg((idx + 1) || ': ' || line, chr(10) ORDER BY idx) AS numbered FROM vlines GROUP BY doc_id"""
)
def line_numbers(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", number_lines(F.col("text")).alias("numbered"))


@query(
    f"""WITH {inputs.VLINES}
SELECT doc_id, idx, line FROM vlines WHERE contains(line, 'tion') AND regexp_matches(line, '(?i)^the')"""
)
def line_contains_all(spark, sf_dir):
    return line_rows.matching_rows(inputs.lines(spark, sf_dir), BOTH)


@query(
    f"""WITH {inputs.VLINES},
left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS text FROM vlines
  WHERE NOT (contains(line, 'the') OR regexp_matches(line, '^[A-M]')) GROUP BY doc_id)
SELECT doc_id, coalesce(l.text, '') AS text FROM documents LEFT JOIN left_over l USING (doc_id)"""
)
def remove_lines(spark, sf_dir):
    kept = matching_lines(split_array(F.col("text")), LineSpec(remove=("the", "^[A-M]")))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("text"))


@query(f"WITH {_KEPT} SELECT doc_id, idx, line, hit FROM kept")
def context_lines(spark, sf_dir):
    return line_rows.context_lines(inputs.lines(spark, sf_dir), SPEC).select("doc_id", "idx", "line", "hit")


@query(f"WITH {_KEPT} SELECT doc_id, idx, block, starts FROM blocks")
def gap_blocks(spark, sf_dir):
    kept = line_rows.context_lines(inputs.lines(spark, sf_dir), SPEC)
    return line_rows.gap_blocks(kept).select("doc_id", "idx", "block", "starts")


@query(f"WITH {_KEPT} SELECT doc_id, idx, CASE WHEN NOT removed THEN line END AS line, removed FROM kept")
def mask_removed(spark, sf_dir):
    kept = line_rows.context_lines(inputs.lines(spark, sf_dir), SPEC)
    return line_rows.mask_removed(kept, SPEC).select("doc_id", "idx", "line", "removed")


@query(_report(True))
def grep_report(spark, sf_dir):
    return report(inputs.table(spark, sf_dir, "documents"), SPEC).select("doc_id", "report")


@query(_report(False))
def grep_report_plain(spark, sf_dir):
    return report(inputs.table(spark, sf_dir, "documents"), PLAIN).select("doc_id", "report")


@query(f"WITH {_KEPT}, {_pieces(True, chr(39) + '```' + chr(39))} SELECT doc_id, idx, piece, out FROM pieces")
def grep_rows(spark, sf_dir):
    return line_rows.grep_rows(inputs.lines(spark, sf_dir), SPEC)


@query(
    f"""WITH {inputs.VLINES},
matched AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS report FROM vlines
  WHERE contains(line, 'tion') AND regexp_matches(line, 'or [a-z]+ing') GROUP BY doc_id)
SELECT doc_id, coalesce(report, '') AS report FROM documents LEFT JOIN matched USING (doc_id)
WHERE contains(text, 'tion') AND regexp_matches(text, 'or [a-z]+ing')"""
)
def contains_both(spark, sf_dir):
    from ..operators.select import file_contains_all
    from ..spec import FileSpec

    spec = FileSpec.containing("tion", "or [a-z]+ing")
    docs = file_contains_all(inputs.table(spark, sf_dir, "documents"), spec.contains)
    return report(docs, spec.lines, ticks=fence(F.col("text"))).select("doc_id", "report")
