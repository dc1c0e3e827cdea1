import random
from hashlib import sha256
from zlib import crc32

import pytest
from odd import SCHEMA, empty_documents, odd_documents
from pyspark.sql import functions as F

from marginalia.llm.integrity import op11_merkle
from marginalia.llm.manifest import fold, leaf_digest, manifest, proof_text


def digest(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves):
    """All levels of a tree and, per leaf, the siblings of its path."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest(*row[i : i + 3]) for i in range(0, len(row), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for row in levels[:-1]:
            run = range(i - i % 3, min(i - i % 3 + 3, len(row)))
            path.append(([row[k] for k in run if k < i], [row[k] for k in run if k > i]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """Contract rows of (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, digest(*map(field, r))))
        trees[name] = (own, *brute_tree([digest(*map(field, r)) for r in own]))
    root, tops = brute_tree([trees[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        own, subroot, paths = trees[name]
        for row, path in zip(own, paths):
            leaf = node = digest(*map(field, row))
            if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = digest(*map(field, (*row[:4], row[4].replace("\n", ""))))
            full = path + top
            for before, after in full:
                node = digest(*before, node, *after)
            proof = digest(*(s for before, after in full for s in before + after))
            out.append((row[0], leaf, subroot, root, proof, node, node == root))
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "one\ntwo\n", "x\n", "no end", "ü\n漢", "\n"])
    return [
        (rng.choice([None, rng.randrange(n), rng.randrange(n), 7]), rng.choice([None, "", "a", "b", "é", "hot", "hot", "hot", "hot"]),
         rng.choice([None, "en"]), rng.choice([None, 3, 12]), text())
        for _ in range(n)
    ]


@pytest.mark.parametrize("n,levels", [(1, 6), (2, 1), (40, 1), (300, 2), (900, 6)])
def test_equals_brute_force(spark, n, levels):
    rows = random_rows(n, n)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(even, leaf_digest(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    proved = manifest(docs, leaf_digest(*fields, F.col("text")), claimed=claimed, levels=levels)
    shown = proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256), "folded_root",
        F.col("folded_root") == F.col("root"),
    )
    got, want = sorted(map(tuple, shown.collect()), key=repr), sorted(brute(rows), key=repr)
    assert got == want
    assert proved.filter(fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert {r.source for r in proved.select("source").distinct().collect()} == {r[1] for r in rows}


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = op11_merkle(spark, sf_dir).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_odd_and_empty_tables(spark):
    leaf = leaf_digest(F.col("doc_id"), F.col("text"))
    rows = manifest(odd_documents(spark).withColumns({"node": F.lit(1), "tree": F.lit("x"), "pos": F.lit(0), "n": F.lit(9)}), leaf)
    assert rows.count() == odd_documents(spark).count()
    assert rows.filter("folded_root = root").count() == rows.count()
    assert rows.filter("source is null").count() == 2 and rows.filter("doc_id is null").count() == 1
    empty = manifest(empty_documents(spark), leaf)
    assert empty.count() == 0 and empty.columns == rows.columns and "doc_id long" in SCHEMA


def test_large_keys_stay_exact(spark):
    keys = [(1 << 62) + 1, (1 << 62) + 2, None]
    docs = spark.createDataFrame([(k, "s") for k in keys], "doc_id long, source string")
    assert {r.doc_id for r in manifest(docs, leaf_digest(F.col("doc_id"))).collect()} == set(keys)
