import random
import re
from collections import Counter

import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from marginalia.llm.classifier import THRESHOLD, quality_model
from marginalia.llm.quality_rules import MEASURES, RuleSpec, beta_prior, host_limit, judge, keep_good
from marginalia.llm.registry import QUERIES
from marginalia.llm.rule_ensemble import STATISTICS, RuleModel, _paths, fit, keep_scored, scored, statistics


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(at, at + 5))
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark, sf_dir):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", " ", " ", "\n", "\r", "\x0b", "#", "é", "\u00a0", "\x1c"]) for _ in range(draw.randint(0, 80))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for row in judge(docs, "text", "source", F.col("doc_id")).collect():
        assert tuple(row[m] for m in MEASURES) == brute_measures(texts[row["row"]])


def test_odd_documents_are_judged(spark):
    docs = odd_documents(spark)
    rows = judge(docs, "text", "source", F.struct("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row[m] for m in MEASURES) == brute_measures(row["row"].text)
        repeats = 100 * row.n_repeat_words > 20 * row.n_words
        assert row.base_failed == (row.n_words < 10 or repeats)
        assert not (row.base_failed and row.kept)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 6, 7, 7]
    assert keep_good(empty_documents(spark)).collect() == []


def test_host_verdict_makes_rules_strict(spark):
    good = "these are ten quite plain words that say nothing new here"
    soft = good + " " + "# " * 3
    bad = "too short"
    rows = [(i, bad, "bad") for i in range(60)] + [(100, soft, "bad"), (101, good, "bad"), (102, soft, "fine"), (103, soft, None)]
    rows += [(200 + i, good, f"h{i % 20}") for i in range(2000)] + [(300 + i, good, "fine") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["row"]: r for r in judge(docs, "text", "source", F.col("doc_id")).collect()}
    assert got[100].host_rejected and not got[100].kept and got[101].kept
    assert got[102].kept and got[103].kept and not got[103].host_rejected


def test_a_host_is_held_to_the_prior_and_to_the_fixed_rate(spark):
    good = "these are ten quite plain words that say nothing new here"
    soft = good + " " + "# " * 3

    def rejected(rates, size=400):
        rows = [(h, soft if i < rate * size else good) for h, rate in enumerate(rates) for i in range(size)]
        docs = spark.createDataFrame(rows, "source int, text string")
        judged = judge(docs, "text", "source", F.struct("source", "text")).collect()
        assert all(r.kept == (not r.host_rejected or r["row"].text == good) for r in judged)
        return {int(r.host) for r in judged if r.host_rejected}

    assert rejected([0.02, 0.02, 0.0225, 0.0175]) == set()  # chance
    assert rejected([0.01] * 19 + [0.08]) == {19}  # an outlier of a clean corpus
    assert rejected([0.2, 0.2, 0.2, 0.0]) == {0, 1, 2}
    assert host_limit(0.0, 1.0, RuleSpec()) == 0.0 and host_limit(0.5, 9.0, RuleSpec()) == 0.1


def test_prior_follows_the_spread_of_hosts(spark):
    def prior(counts):
        return beta_prior(spark.createDataFrame(counts, "n_docs long, n_failed long"))

    assert prior([]) [1] == 1.0 and prior([(10, 0), (5, 0)]) == (0.0, 1.0)
    alike = prior([(1000, 100)] * 20)
    apart = prior([(1000, 0)] * 10 + [(1000, 200)] * 10)
    assert alike[0] == apart[0] == pytest.approx(0.1) and alike[1] > 100 * apart[1]


def test_statistics_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = statistics(docs, "text", F.col("doc_id")).collect()
    assert len(rows) == docs.count()
    assert all(row[name] is not None for row in rows for name in STATISTICS)
    blank = [r for r in rows if r["row"] in (2, 3)]
    assert all(row[name] == 0 for row in blank for name in STATISTICS)


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 2.5)
   If (feature 0 <= 1.5)
    Predict: 0.0
   Else (feature 0 > 1.5)
    Predict: 1.0
  Else (feature 0 > 2.5)
   Predict: 1.0
"""
    name = STATISTICS[0]
    assert _paths(tree) == {
        ((name, "<=", 2.5),), ((name, "<=", 1.5),), ((name, "<=", 2.5), (name, ">", 1.5)), ((name, ">", 2.5),)
    }


def test_labels_of_one_kind_give_a_constant(spark):
    docs = odd_documents(spark)
    model = fit(docs.withColumn("label", F.lit(1)))
    assert model.rules == () and model.base > 0
    assert fit(empty_documents(spark).withColumn("label", F.lit(1))) == RuleModel(0.0)
    scores = [r.score for r in scored(docs, model, "text", F.col("doc_id")).collect()]
    assert len(scores) == docs.count() and len(set(scores)) == 1
    kept = keep_scored(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    judged = QUERIES["op4_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = judged.join(labels, "doc_id").filter("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_labels_of_the_held_out_fold_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = labels.withColumn("quality", F.when(fold == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_model(docs, labels) == quality_model(docs, turned)
    assert RuleSpec().min_words == 10
