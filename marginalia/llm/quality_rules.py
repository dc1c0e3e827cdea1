"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured inside its own row. The documents that fail a rule are counted per host, the hosts' failure
rates are shrunk towards a beta prior that is fitted to all hosts, and the host's verdict goes back to its documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import SPACE, count_chars, without, words_of

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleSpec:
    """Limits of the rules; shares are in percent of the words or lines of the document.

    A host is rejected above ``max_host_rate``, or above the prior's mean by ``host_deviations`` of its standard
    deviations where that is lower: a corpus that fails often is held to the fixed rate, in a clean one outliers go.
    """

    min_words: int = 10
    max_repeat_words: int = 20
    max_symbols: int = 10
    max_dup_lines: int = 30
    min_word_chars: int = 2
    max_word_chars: int = 12
    max_host_rate: float = 0.1
    host_deviations: float = 2.0


def measured(docs: DataFrame, text: str, host: str, carry: Column) -> DataFrame:
    """One row per document: ``row`` (what ``carry`` gives), ``host``, ``n_lines`` and the measures (all long).

    The words that repeated windows cover are found in two steps. Hashes of the windows show whether any window can
    occur twice; only then the windows themselves are sorted, equal neighbours marked, and the marked stretches added
    up. Both steps stay within the row and are linear, up to the sort, in the number of words.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    start = docs.select(
        carry.alias("row"),
        F.col(host).cast("string").alias("host"),
        words_of(value).alias("words"),
        F.filter(F.split(value, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(without(value, SPACE + "+")).cast("bigint").alias("word_chars"),
        count_chars(value, "[#*$%&|<>]").alias("n_symbols"),
    )
    hashed = start.select(
        "row", "host", "words", "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    )
    last = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    windows = hashed.withColumn(
        "windows",
        F.transform(
            F.slice("hashes", F.lit(1), last),
            lambda first, at: F.xxhash64(first, *[F.get("hashes", at + k) for k in range(1, WINDOW)]),
        ),
    ).drop("hashes")
    ranked = windows.withColumn(
        "ranked",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), last),
                    lambda at: F.struct(F.array_join(F.slice("words", at, F.lit(WINDOW)), " ").alias("window"), at.alias("at")),
                )
            ),
        ),
    ).drop("windows", "words")
    same = lambda a, b: F.coalesce(a["window"] == b["window"], F.lit(False))
    placed = ranked.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter(
                    "ranked",
                    lambda x, i: same(x, F.get("ranked", i - 1)) | same(x, F.get("ranked", i + 1)),
                ),
                lambda x: x["at"],
            )
        ),
    ).drop("ranked")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")),
        lambda acc, at: F.struct(
            (at + WINDOW).alias("upto"),
            (acc["total"] + at + WINDOW - F.greatest(at, acc["upto"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return placed.select("row", "host", "n_lines", *MEASURES[:-1], F.coalesce(covered, F.lit(0)).cast("bigint").alias(MEASURES[-1]))


def base_failed(spec: RuleSpec) -> Column:
    repeats = 100 * F.col("n_repeat_words") > spec.max_repeat_words * F.col("n_words")
    return (F.col("n_words") < spec.min_words) | repeats


def any_failed(spec: RuleSpec) -> Column:
    """Whether the document fails one of all rules; the base rules are among them."""
    return (
        base_failed(spec)
        | (100 * F.col("n_symbols") > spec.max_symbols * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > spec.max_dup_lines * F.col("n_lines"))
        | (F.col("word_chars") < spec.min_word_chars * F.col("n_words"))
        | (F.col("word_chars") > spec.max_word_chars * F.col("n_words"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior, by the moments of the hosts' failure counts.

    The spread of the rates beyond what counting noise explains gives the share of variance between hosts; its inverse,
    less one, is the strength. The sums are one row, whatever the number of hosts. Without hosts, or where no host or
    every document fails, the prior is the mean with a strength of 1.
    """
    n, failed = F.col("n_docs"), F.col("n_failed")
    k, total, bad, squares, rates = hosts.agg(
        F.count(F.lit(1)), F.sum(n), F.sum(failed), F.sum(n.cast("double") * n), F.sum(failed.cast("double") * failed / n)
    ).first()
    if not total or bad in (0, total):
        return (bad / total if total else 0.0), 1.0
    mean = bad / total
    noise = mean * (1 - mean)
    room = total - squares / total - (k - 1)
    between = (rates - mean * mean * total - noise * (k - 1)) / (noise * room) if room > 0 else 0.0
    between = min(max(between, 1e-4), 0.999)
    return mean, 1 / between - 1


def host_limit(mean: float, strength: float, spec: RuleSpec) -> float:
    """The shrunk failure rate above which a host is rejected, under a beta prior of this mean and strength."""
    return min(spec.max_host_rate, mean + spec.host_deviations * math.sqrt(mean * (1 - mean) / (strength + 1)))


def judge(docs: DataFrame, text: str, host: str, carry: Column, spec: RuleSpec = RuleSpec()) -> DataFrame:
    """One row per document with ``row``, the measures, ``base_failed``, ``host_rejected`` and ``kept``.

    ``carry`` is the column that goes along as ``row`` (a struct of whatever the caller needs later), so no name of
    the input can clash with the results. A document that fails a base rule goes. A host is rejected if its shrunk
    failure rate is above ``host_limit``; its documents then stay only if they fail none of the rules, whereas a
    sound host is forgiven a failure beyond the base rules. A document with a null host has no host verdict. Null texts
    have no words and fail; repeated rows are documents of their own; an empty table gives no rows.

    The measures are written once to the shared folder and read twice, so texts are read once. Documents are counted
    per host before any shuffle. The counts are written too, so their size is known when the verdicts are joined on the
    host: Spark broadcasts them while they are few, and what ``carry`` holds is then not shuffled; it splits a hot
    host's documents otherwise.
    """
    rows = materialize(
        measured(docs, text, host, carry).withColumns({"base_failed": base_failed(spec), "failed": any_failed(spec)}),
        "measures",
    )
    counted = materialize(
        rows.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed")),
        "hosts",
    )
    mean, strength = beta_prior(counted)
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    verdicts = counted.select("host", (rate > host_limit(mean, strength, spec)).alias("host_rejected"))
    joined = rows.join(verdicts, "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select(
        "row", "host", *MEASURES, "base_failed",
        rejected.alias("host_rejected"),
        (~F.col("base_failed") & ~(rejected & F.col("failed"))).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", spec: RuleSpec = RuleSpec()) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(docs, text, host, row, spec).filter("kept").select("row.*")
