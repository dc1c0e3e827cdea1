import zlib
from collections import Counter, defaultdict

import pytest
from odd import LONG, empty_documents, odd_documents
from pyspark.sql import functions as F

from marginalia.llm import sharding
from marginalia.llm.layout import op6_sharding
from marginalia.llm.mixing import mix, mixed
from marginalia.llm.ordered import running_sum
from marginalia.llm.sharding import SHARDS, shard_documents


def check_shards(rows, shards=SHARDS):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def groups_of(rows):
    shards = defaultdict(Counter)
    for r in rows:
        shards[r.text_crc32, r["size"]][r.shard] += 1
    return [held for held in shards.values() if sum(held.values()) > 1]


def test_shards_of_the_tables(spark, sf_dir):
    rows = op6_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_shards(rows)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "rows", None)
    groups = groups_of(rows)
    assert sum(len(held) > 1 for held in groups) <= 0.05 * len(groups)


def test_hot_groups_are_split_and_others_kept_together(spark):
    texts = ["hot"] * 700 + [f"pair {i // 2}" for i in range(600)] + [f"single {i}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard_documents(docs).collect()
    check_shards(rows)
    groups = groups_of(rows)
    pairs = [held for held in groups if sum(held.values()) == 2]
    assert len(pairs) == 300 and sum(len(held) > 1 for held in pairs) <= 15
    (hot,) = [held for held in groups if sum(held.values()) == 700]
    assert len(hot) <= 10


@pytest.mark.parametrize("large", [64, 1])
def test_groups_that_fit_stay_whole(spark, monkeypatch, large):
    """Mostly copies: a group beyond a shard, some large ones, many small ones; all that fit are whole."""
    monkeypatch.setattr(sharding, "LARGE", large, raising=False)
    sizes = [3300, 500] + [100] * 5 + [30] * 60 + [4] * 500 + [2] * 900
    groups = [f"g{g}" for g, n in enumerate(sizes) for _ in range(n)] + [None] * 600
    frame = spark.createDataFrame(list(enumerate(groups)), "row_id long, `group` string").repartition(5, "row_id")
    rows = sharding.assign(frame).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(groups) and max(counts.values()) - min(counts.values()) <= 1
    shards = defaultdict(set)
    for r in rows:
        shards[groups[r.row_id]].add(r.shard)
    assert len(shards["g0"]) <= 9
    assert [g for g, held in shards.items() if g not in ("g0", None) and len(held) > 1] == []


def test_more_copies_than_room(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(333)], "doc_id long, text string")
    check_shards(shard_documents(docs).collect())


def test_odd_documents_get_shards(spark):
    docs = odd_documents(spark)
    rows = shard_documents(docs).collect()
    check_shards(rows)
    assert sorted(r["size"] for r in rows)[:2] == [1, 1] and max(r["size"] for r in rows) == len(LONG.encode()) + 1
    assert shard_documents(empty_documents(spark)).collect() == []


def test_running_sums_over_ranges(spark):
    frame = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = running_sum(frame, ["k"], F.col("v"), "upto").orderBy("k").collect()
    total = 0
    for r in rows:
        total += r.v
        assert r.upto == total
    assert running_sum(frame.limit(0), ["k"], F.col("v"), "upto").collect() == []


def targets_of(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Targets by resharing round by round; sizes by source, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[at % len(weights)] for at, s in enumerate(order)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = left / (sum(weight[s] for s in order if s not in capped) or 1)
        above = {s for s in order if s not in capped and weight[s] * level >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


def check_mix(docs, rows, tolerance=0.5):
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    targets = targets_of({s: sizes[s] for s in {r.source for r in rows}})
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= tolerance * largest[source] + 1e-6


def test_mix_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    check_mix(docs, rows)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.id, r.taken) for r in rows) == sorted((r.id, r.taken) for r in again)


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    check_mix(docs, rows, tolerance=2)
    assert {r.id: r["size"] for r in rows}[2] == 0
    taken = Counter(r.id for r in rows for _ in range(r.copies))
    out = mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == taken
    assert mix(empty_documents(spark)).collect() == [] == mixed(empty_documents(spark)).collect()


def test_heavier_documents_are_drawn_earlier(spark):
    clean, noisy = "a b c d e f g h", "a # b # c # d # e # f # g # h #"
    rows = [(i, clean if i % 2 else noisy, "s") for i in range(2000)] + [(5000 + i, "x y", "t") for i in range(10000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.id: r.copies for r in mix(docs).filter("source = 't'").collect()}
    assert set(taken.values()) <= {0, 1, 2}
    wide = spark.createDataFrame([(i, clean if i % 2 else noisy, "b" if i < 2000 else "a") for i in range(4000)], docs.schema)
    drawn = [r for r in mix(wide).collect() if r.source == "b"]
    extra = Counter((r.id % 2, r.copies) for r in drawn)
    assert extra  # both kinds occur, the clean ones with more copies
    mean = {kind: sum(k * n for (p, k), n in extra.items() if p == kind) / 1000 for kind in (0, 1)}
    assert mean[1] >= mean[0]


@pytest.mark.parametrize("hot", [7, None])
def test_cut_goes_between_copies(spark, hot):
    """A source that consists of copies of one id reaches its target in the plan and in the rows."""
    rows = [(hot, "a b c d e f g h i j", "b")] * 400 + [(hot, "k l m n o p q r s t", "b")] * 200
    rows += [(1000 + i, "u v w x y z", s) for i in range(900) for s in ("a", "c")] + [(None, "one two three", None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mix(docs).collect()
    check_mix(docs, planned)
    assert {r.source for r in planned if r.source == "b" and 1 < r.target / r.source_size < 2 or 0 < r.target / r.source_size < 1}
    taken = Counter()
    for r in planned:
        taken[r.source] += r.taken
    out = Counter()
    for r in mixed(docs).collect():
        out[r.source] += len(r.text.split())
    assert out == taken


def test_null_sources_come_last(spark):
    rows = [(1, "a " * 100, None), (2, "b " * 100, "z"), (3, "c " * 100, "é"), (4, "d " * 100, "Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source: r.target for r in mix(docs).collect()}
    assert targets == pytest.approx(targets_of({None: 100, "z": 100, "é": 100, "Z": 100}))
