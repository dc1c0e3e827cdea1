from collections import Counter

import corpus_pipeline
import public_tokenizers
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F
from test_quality import brute_measures
from test_simhash import brute_classes, brute_fingerprint

from marginalia.llm.classifier import THRESHOLD, quality_model
from marginalia.llm.rule_ensemble import scored
from marginalia.session import materialize

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    """Each stage is held against plain loops over what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model(source, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["row"] for r in scored(source, model, "text", F.col("doc_id")).filter(F.col("score") >= THRESHOLD).collect()}
    assert {r.doc_id for r in kept[names[0]]} == good and len(kept[names[0]]) == len(good)

    def base(text):
        n, _, _, _, repeats = brute_measures(text)
        return n >= 10 and 100 * repeats <= 20 * n

    assert {r.doc_id for r in kept[names[1]]} == {r.doc_id for r in kept[names[0]] if base(r.text)}
    ranked = sorted(kept[names[1]], key=lambda r: r.doc_id)
    roots = brute_classes([brute_fingerprint(r.text) for r in ranked])
    assert {r.doc_id for r in kept[names[2]]} == {ranked[at].doc_id for at in set(roots)}
    texts = {r.doc_id: r.text for r in kept[names[2]]}
    copies = Counter(r.doc_id for r in kept[names[3]])
    assert set(copies.values()) <= {1, 2} and all(r.text == texts[r.doc_id] for r in kept[names[3]])
    assert Counter(r.doc_id for r in kept[names[4]]) == copies
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r.text.split()) for r in kept[names[3]]) / total - 1.5) < 0.05


def test_labelled_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    left = corpus_pipeline.apply_rules(spark, corpus_pipeline.classify(spark, docs, SF), SF)
    assert clean.join(left, "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_odd_and_empty_documents_pass_all_stages(spark):
    assert public_tokenizers.path(corpus_pipeline.RANKS)
    for docs in (odd_documents(spark), empty_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "test")
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        docs.collect()


def test_run_gives_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
