"""A quality classifier of weighted rules over text statistics.

A random forest over the statistics of labelled documents gives candidate rules: the conjunction of the splits on the
way to each of its nodes. A logistic regression with an L1 penalty over these rules keeps few of them with a weight.
The rules become one column expression, so scoring is a projection over the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import count_chars, words_of

SAMPLE = 20_000
SAMPLE_PARTITIONS = 8
TREES = 24
DEPTH = 3
PENALTY = 0.001
SEED = 7
STATISTICS = (
    "log_words", "word_length", "distinct_share", "longest_word", "symbol_share", "digit_share", "upper_share",
    "mark_share", "line_length", "dup_line_share",
)

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """``base`` and the weights of rules (conjunctions of ``(statistic, "<=" or ">", threshold)``) on the logit scale."""

    base: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = field(default=())


def statistics(docs: DataFrame, text: str, carry: Column) -> DataFrame:
    """``row`` (what ``carry`` gives) and the statistics of each text as doubles; all are 0 for a null or empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(
        carry.alias("row"),
        words_of(body).alias("words"),
        lines.alias("lines"),
        F.length(body).alias("chars"),
        count_chars(body, r"[\x20\x09-\x0D]").alias("spaces"),
        count_chars(body, "[#*$%&|<>]").alias("symbols"),
        count_chars(body, "[0-9]").alias("digits"),
        count_chars(body, "[A-Z]").alias("uppers"),
        count_chars(body, "[.,;:!?]").alias("marks"),
    )
    sized = cut.select(
        "row", "chars", "spaces", "symbols", "digits", "uppers", "marks",
        F.size("words").alias("n"),
        F.size(F.array_distinct("words")).alias("distinct"),
        F.array_max(F.transform("words", lambda word: F.length(word))).alias("longest"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("distinct_lines"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)).cast("double")
    letters = F.col("chars") - F.col("spaces")
    return sized.select(
        "row",
        F.log1p("n").alias("log_words"),
        F.coalesce(F.try_divide(letters, F.col("n")), F.lit(0.0)).alias("word_length"),
        share("distinct", "n").alias("distinct_share"),
        F.coalesce("longest", F.lit(0)).cast("double").alias("longest_word"),
        share("symbols", "chars").alias("symbol_share"),
        share("digits", "chars").alias("digit_share"),
        share("uppers", "chars").alias("upper_share"),
        share("marks", "n").alias("mark_share"),
        share("chars", "n_lines").alias("line_length"),
        F.coalesce(1 - F.try_divide(F.col("distinct_lines"), F.col("n_lines")), F.lit(0.0)).alias("dup_line_share"),
    )


def _paths(tree: str) -> set[tuple[Condition, ...]]:
    """The conjunctions that lead to the nodes of a tree below its root, from its printed form."""
    found, stack = set(), []
    for line in tree.splitlines():
        split = re.fullmatch(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not split:
            continue
        depth, condition = len(split[1]), (STATISTICS[int(split[2])], split[3], float(split[4]))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, condition))
        tightest: dict[tuple[str, str], float] = {}
        for _, (name, side, at) in stack:
            choose = min if side == "<=" else max
            tightest[name, side] = choose(at, tightest.get((name, side), at))
        found.add(tuple(sorted((name, side, at) for (name, side), at in tightest.items())))
    return found


def _holds(rule: tuple[Condition, ...]) -> Column:
    conditions = [F.col(name) <= at if side == "<=" else F.col(name) > at for name, side, at in rule]
    return reduce(lambda a, b: a & b, conditions)


def fit(labelled: DataFrame, text: str = "text", label: str = "label") -> RuleModel:
    """The rules and weights for texts with a label of 0 or 1; rows with another label or none are left out.

    Give it a bounded sample, as ``sampled`` makes it: its statistics, not its texts, are written to the shared folder
    and read by the forest and the regression. With labels of one kind only the score is their smoothed share.
    """
    known = labelled.filter(F.col(label).isin(0, 1))
    rows = statistics(known, text, F.col(label).cast("double")).withColumnRenamed("row", "label")
    # The sample is dealt anew, as a few partitions serve the training and the scan must keep its own; sorted, so reruns agree.
    dealt = rows.repartition(SAMPLE_PARTITIONS, F.xxhash64(*STATISTICS)).sortWithinPartitions(*STATISTICS, "label")
    rows = materialize(dealt, "statistics")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (good + 1) / (n + 2)
    if good in (0, n):
        return RuleModel(math.log(share / (1 - share)))
    vector = array_to_vector(F.array(*STATISTICS)).alias("features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED
    ).fit(rows.select("label", vector))
    rules = sorted(set().union(*(_paths(tree.toDebugString) for tree in forest.trees)))
    if not rules:
        return RuleModel(math.log(share / (1 - share)))
    marks = array_to_vector(F.array(*[_holds(rule).cast("double") for rule in rules])).alias("features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(rows.select("label", marks))
    weighted = tuple((rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray()) if w)
    return RuleModel(float(lasso.intercept), weighted)


def sampled(docs: DataFrame, labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """The documents of up to ``sample`` labelled keys (those with the smallest digests), with their label.

    Keys whose labels differ are left out. The sample is bounded, so it is broadcast to the documents, and only the texts
    that are in it are measured.
    """
    one = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    sure = one.filter(F.col("low") == F.col("high")).select(F.col(key).alias("sample_key"), F.col("low").alias("sample_label"))
    chosen = sure.orderBy(F.xxhash64("sample_key"), "sample_key").limit(sample)
    return docs.join(F.broadcast(chosen), F.col(key) == F.col("sample_key"))


def scored(docs: DataFrame, model: RuleModel, text: str, carry: Column) -> DataFrame:
    """``row`` (what ``carry`` gives) and ``score``, between 0 and 1, of each text; null and empty texts get one too.

    One row per row of ``docs``; nothing is shuffled.
    """
    logit = F.lit(model.base)
    for rule, weight in model.rules:
        logit = logit + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return statistics(docs, text, carry).select("row", (1 / (1 + F.exp(-logit))).alias("score"))


def keep_scored(docs: DataFrame, model: RuleModel, threshold: float, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return scored(docs, model, text, row).filter(F.col("score") >= threshold).select("row.*")
