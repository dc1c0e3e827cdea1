import random

from pyspark.sql import functions as F

from marginalia.llm import topk
from marginalia.llm.topk import quantised, top_k


def brute(rows, every, k):
    answers = {}
    for query, vector in rows:
        if query % every:
            continue
        scores = [(-sum(a * b for a, b in zip(vector, other)), i) for i, other in rows if i != query]
        answers[query] = [(place, i, -s) for place, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return answers


def asked(spark, rows, every, k, **options):
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    answers = {}
    for r in top_k(frame, F.col("id") % every == 0, k, **options).collect():
        answers.setdefault(r.query, []).append((r.rank, r.id, r.score))
    return {query: sorted(found) for query, found in answers.items()}


def test_equals_brute_force_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "ANNULUS", 8)
    draw = random.Random(5)
    clusters = [[draw.randint(-300, 300) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + draw.randint(-9, 9) for c in draw.choice(clusters)]) for i in range(700)]
    rows += [(1000 + i, clusters[0]) for i in range(200)]
    assert asked(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert asked(spark, rows, 50, 1, pivot_count=3) == brute(rows, 50, 1)


def test_cells_that_cannot_answer_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 50)
    seen = []
    plain = topk._routed
    monkeypatch.setattr(topk, "_routed", lambda *a: seen.append(plain(*a)) or seen[-1])
    draw = random.Random(6)
    centres = [[1000 if k == c else 0 for k in range(8)] for c in range(8)]
    rows = [(i, [x + draw.randint(-3, 3) for x in centres[i % 8]]) for i in range(800)]
    assert asked(spark, rows, 100, 3) == brute(rows, 100, 3)
    assert seen[0].select("id", "cell").distinct().count() < 8 * 8


def test_odd_vectors(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [3, 4]), (2, None), (None, [1, 2]), (4, [1]), (5, [3, 4]), (50, [0, 0]), (7, [])]
    got = asked(spark, rows, 50, 5)
    assert got[0] == [(1, 1, 11), (2, 5, 11), (3, 50, 0)]
    assert got[50] == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 5, 0)]
    assert asked(spark, [], 50, 5) == {}
    assert asked(spark, [(3, [1])], 50, 5) == {}
    assert asked(spark, [(50, [1])], 50, 5) == {}


def test_repeated_queries_in_a_small_cell(spark):
    """Copies of a query do not raise its bound above its k-th best score."""
    near = [(1, [990, 3]), (2, [995, -4]), (3, [1001, 7])]
    far = [(100 + 3 * i, [-1000 + i % 7, i % 5]) for i in range(60)]
    rows = [*near, *far, (50, [1000, 1]), (50, [1000, 1])]
    assert asked(spark, rows, 50, 5, pivot_count=2) == brute(rows, 50, 5)
    rows = [*near, *far, (50, [1003, 2]), (50, [-1001, 1]), (50, [-1001, 1])]
    assert asked(spark, rows, 50, 5, pivot_count=2) == brute(rows, 50, 5)


def test_quantised_values(spark):
    rows = [([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<float>").select(quantised(F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == [[128, -1], None, None, None, None, []]
