import random

import pytest

from marginalia.catalog import inputs
from marginalia.operators.search import corpus_search
from marginalia.operators.text_index import build_index, open_index, rarest_grams, search_index


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return inputs.page_text(spark, sf_dir).limit(150).cache()


@pytest.fixture(scope="module")
def index(pages):
    return build_index(pages)


def hits(rows):
    return sorted((r["query"], r["page_id"], r["url"]) for r in rows.collect())


def asked(spark, queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_thousand_queries_equal_a_scan(spark, pages, index):
    rng = random.Random(6)
    texts = [r["text"] for r in pages.select("text").collect() if r["text"]]
    queries = set()
    while len(queries) < 1000:
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        part = text[at : at + rng.randint(1, 12)].strip()
        queries.add(rng.choice([part, part.upper(), f"{part} {rng.choice(texts)[:4]}", part + "zq"]))
    want = []
    bodies = [(r["page_id"], r["url"], (r["text"] or "").lower()) for r in pages.collect()]
    for query in queries:
        want += [(query, p, u) for p, u, body in bodies if all(t in body for t in query.lower().split())]
    assert hits(search_index(index, asked(spark, queries))) == sorted(want)
    few = sorted(queries)[:20]
    assert hits(search_index(index, asked(spark, few))) == hits(corpus_search(pages, few, "text"))


def test_absent_terms_read_no_text(spark, index):
    unread = index._replace(pages=None)
    rows = search_index(unread, asked(spark, ["qqzzqq", "the qqzzqq", None]))
    assert rows.count() == 0 and rows.columns == ["query", "page_id", "url"]


def test_rarest_run_and_odd_queries(spark, pages, index):
    got = {r["query"]: r["gram"] for r in rarest_grams(index, asked(spark, ["", " \t", "a", "THE The", "xx "])).collect()}
    assert got[""] == "" and got[" \t"] == "" and got["a"] == "a" and got["THE The"] == "the"
    assert len(hits(search_index(index, asked(spark, ["", ""])))) == pages.count()


def test_reopened_and_repeated(spark, tmp_path):
    rows = [(1, "u1", "Some Text"), (1, "u1b", "other text"), (2, "u2", None), (3, "u3", "text " * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string")
    build_index(pages, folder=str(tmp_path / "index"))
    index = open_index(spark, str(tmp_path / "index"))
    assert hits(search_index(index, asked(spark, ["text", "some", "TEXT other"]))) == [
        ("TEXT other", 1, "u1b"), ("some", 1, "u1"), ("text", 1, "u1"), ("text", 1, "u1b"), ("text", 3, "u3"),
    ]
    exact = build_index(pages, ignore_case=False)
    assert hits(search_index(exact, asked(spark, ["Some", "some"]), ignore_case=False)) == [("Some", 1, "u1")]


def test_only_needed_folders_are_read(spark, index):
    rare = next(r["gram"] for r in index.counts.filter("pages = 1 AND length(gram) = 3 AND trim(gram) = gram").collect())
    rows = search_index(index, asked(spark, [rare]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "part IN" in plan.split("PartitionFilters: ")[1] or "part#" in plan.split("PartitionFilters: ")[1]


def test_runs_of_long_and_odd_texts(spark):
    import pyarrow as pa

    from marginalia.operators.text_index import BATCH_RUNS, _postings

    bodies = ["", "a😀b", "xyz" * 20, "".join(chr(0x4E00 + n % 20000) for n in range(BATCH_RUNS // 2))]
    batch = pa.RecordBatch.from_arrays([pa.array([None, 1, 2, 3], pa.int64()), pa.array(bodies)], ["page_id", "body"])
    found = pa.Table.from_batches(list(_postings(iter([batch])))).to_pylist()
    runs = lambda page: sorted(r["gram"] for r in found if r["page_id"] == page)
    assert runs(None) == [""] and runs(1) == sorted(["", "a", "😀", "b", "a😀", "😀b", "a😀b"])
    assert runs(2) == sorted(["", "x", "y", "z", "xy", "yz", "zx", "xyz", "yzx", "zxy"])
    assert len(runs(3)) == 1 + 3 * 20000


def test_candidates_grow_with_pages_not_with_pairs(spark, monkeypatch):
    import itertools

    from marginalia.operators import text_index

    written = {}

    def counted(rows, purpose, keep=text_index.materialize):
        kept = keep(rows, purpose)
        written[purpose] = kept.count()
        return kept

    monkeypatch.setattr(text_index, "materialize", counted)
    rng = random.Random(4)
    bodies = ["aaababbbaa " + "".join(rng.choice("ab") for _ in range(60)) for _ in range(50)]
    rows = [(None if n == 7 else n, f"u{n}", body) for n, body in enumerate(bodies)]
    queries = ["".join(q) for q in itertools.product("ab", repeat=6)]
    found = build_index(spark.createDataFrame(rows, "page_id long, url string, text string"))
    got = {(r["query"], r["url"]) for r in search_index(found, asked(spark, queries)).collect()}
    assert got == {(q, u) for q in queries for _, u, body in rows if q in body}
    assert written == {"grams": 64, "candidates": 50}


def test_blocks_of_queries_and_shares_of_pages(spark, pages, index, monkeypatch):
    from marginalia.operators import text_index

    for name, value in (("BLOCK", 16), ("SHARE_PAGES", 8), ("CHUNK", 1000), ("CELLS", 50)):
        monkeypatch.setattr(text_index, name, value)
    words = sorted({w for r in pages.limit(20).select("text").collect() for w in r["text"].split()[:9]})
    queries = [*words, *(f"{a} {b}" for a, b in zip(words, reversed(words))), ""]
    assert len(queries) > 100
    bodies = [(r["page_id"], r["url"], r["text"].lower()) for r in pages.collect()]
    want = [(q, p, u) for q in set(queries) for p, u, body in bodies if all(t in body for t in q.lower().split())]
    assert hits(search_index(index, asked(spark, queries))) == sorted(want)


def test_terms_of_any_length_are_found_wherever_they_stand(monkeypatch):
    import pyarrow as pa

    from marginalia.operators import text_index

    rng = random.Random(9)
    letters = ["a", "b", "ab", "é", "😀", "\0", "aaaaaaaa"]
    bodies = [b"", b"\xff\xfea", *("".join(rng.choices(letters, k=rng.randint(0, 60))).encode() for _ in range(200))]
    terms = {b"a", b"\xff", b"\0", b"b" * 50}
    while len(terms) < 600:
        body = rng.choice(bodies)
        at = rng.randrange(len(body) + 1)
        terms.add(body[at : at + rng.randint(1, 40)] + rng.choice([b"", b"", b"b"]) or b"c")
    terms = sorted(terms)
    queries = [[], *([t] for t in terms), *(rng.sample(terms, rng.randint(2, 4)) for _ in range(200))]
    asked_rows = pa.table({
        "turn": pa.array([0] * len(queries), pa.int64()), "query": [str(n) for n in range(len(queries))],
        "terms": pa.array(queries, pa.list_(pa.binary())),
    })
    page_rows = pa.table({"turn": pa.array([1] * len(bodies), pa.int64()), "page_id": list(range(len(bodies))), "url": ["u"] * len(bodies), "body": bodies})
    rows = pa.concat_tables([asked_rows, page_rows], promote_options="default")
    want = {(n, str(q)) for n, body in enumerate(bodies) for q, of in enumerate(queries) if all(t in body for t in of)}
    for chunk, cells, batch in ((1 << 18, 1 << 20, 10000), (7, 3, 100), (100, 5000, 33)):
        monkeypatch.setattr(text_index, "CHUNK", chunk)
        monkeypatch.setattr(text_index, "CELLS", cells)
        found = [r for b in text_index._answers(iter(rows.to_batches(max_chunksize=batch)), 1) for r in b.to_pylist()]
        assert [r["page_id"] for r in found] == list(range(len(bodies)))
        assert {(r["page_id"], q) for r in found for q in r["found"]} == want
        assert sum(len(r["found"]) for r in found) == len(want)


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    rows = [(n, f"u{n}", f"text of {n}") for n in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string")
    monkeypatch.setattr(type(pages), "repartition", lambda *of: pytest.fail("postings are shuffled"))
    found = build_index(pages, folder=str(tmp_path / "index"))
    assert found.postings.filter("gram = 'tex'").count() == found.postings.filter("gram = ''").count() == 300
    assert found.postings.groupBy("gram", "page_id").count().filter("count > 1").isEmpty()
