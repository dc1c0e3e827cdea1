import random
import re

import numpy as np
import pytest
import xxhash
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.registry import QUERIES
from marginalia.llm.simhash import (
    BITS,
    block_masks,
    drop_near_duplicates,
    fingerprint,
    gray_rank,
    links,
    near_duplicates,
)


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_classes(codes, most=2):
    """For each code the smallest place that it is linked to."""
    codes = np.array(codes, dtype=np.uint64)
    low = list(range(len(codes)))

    def root(at):
        while low[at] != at:
            at = low[at]
        return at

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= most) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            low[b] = a
    return [root(i) for i in range(len(codes))]


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def test_fingerprints_equal_brute_force(spark, sf_dir):
    draw = random.Random(4)
    texts = ["".join(draw.choice("aAbé \n\t\x1c .") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert all(fingerprint(t) == brute_fingerprint(t) for t in texts)


def test_gray_ranks_are_in_gray_order(spark):
    codes = [n ^ n >> 1 for n in (0, 1, 2, 3, 1000, (1 << 63) - 1, 1 << 63, (1 << 64) - 1)]
    rows = spark.createDataFrame([(k, signed(c)) for k, c in enumerate(codes)], "k int, code long")
    assert [r.k for r in rows.orderBy(gray_rank(F.col("code"))).collect()] == list(range(len(codes)))


def test_blocks_cover_all_links():
    draw = random.Random(8)
    leaves = {mask for masks in block_masks()[-1].values() for mask in masks}
    assert 9 < len(leaves) <= 27
    for _ in range(500):
        apart = sum(1 << bit for bit in draw.sample(range(BITS), 2))
        assert any(not apart & mask for mask in leaves)


@pytest.mark.parametrize("max_bucket", [1000, 4])
def test_links_equal_brute_force(spark, max_bucket):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    codes = set(base)
    for code in base[:40]:
        for _ in range(30):  # chains of near codes, some links of one bit and some of two
            for _ in range(draw.choice([1, 2])):
                code ^= 1 << draw.randrange(64)
            codes.add(code)
    codes = sorted(codes, key=signed)
    frame = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    found = {r.node: r.root for r in components(links(frame, max_bucket=max_bucket)).collect()}
    want = [signed(codes[low]) for low in brute_classes(codes)]
    assert [found.get(signed(c), signed(c)) for c in codes] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299), (299, 300)]
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)} | {300: 299}
    assert found == want
    assert components(frame.limit(0)).collect() == []


def test_components_of_documents_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts)
    codes = [brute_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{code:016x}", ids[low]) for i, code, low in zip(ids, codes, brute_classes(codes))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, folder).collect()}
    assert got == want


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = sorted((r.doc_id or 0, r.component) for r in near_duplicates(docs).collect())
    assert len(got) == docs.count()
    assert dict(got) == {0: None, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 1, 7: 7, 9: 9}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 9]
    clash = drop_near_duplicates(docs.withColumns({"kept_row": F.lit("x"), "component": F.lit(1), "fingerprint": F.lit("f"), "kept_key": F.lit(2)}))
    assert clash.columns == [*docs.columns, "kept_row", "component", "fingerprint", "kept_key"] and clash.count() == kept.count()
    assert near_duplicates(empty_documents(spark)).collect() == [] == drop_near_duplicates(empty_documents(spark)).collect()


def test_rows_are_kept_by_row_and_not_by_id(spark):
    a, b, c = (f"text {x} " + " ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, b), (None, c), (None, c), (None, "alone without an id")]
    for seed in range(3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)
        got = sorted((r.text, r.doc_id) for r in drop_near_duplicates(docs).collect())
        assert got == sorted([(a, 3), (b, 7), (c, 9), ("alone without an id", None)])
