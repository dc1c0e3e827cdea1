"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component that gives all of them the same length. Then the inner product falls as the Euclidean
distance grows, and the triangle inequality holds. Each vector is keyed by its nearest pivot and its distance to it.
Within the cell of a pivot the vectors are sorted by that distance. A query knows a lower bound of its k-th best score
from its own cell; it visits only cells and, from its own distance outwards, annuli that can hold something as good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

PIVOTS = 16
PIVOT_SAMPLE = 4096
CELL_ROWS = 4096
QUERY_ROWS = 4096
ANNULUS = 256
#: Relative error allowed to bounds, which are kept in double precision.
SLACK = 1e-9
NONE = -(1 << 62)
NO_ID = (1 << 63) - 1
ANSWER = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; null if the vector is null or holds a null or non-finite component."""
    doubled = F.transform(vector, lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(doubled, lambda x: F.floor(x * scale).cast("bigint"))
    return F.when(vector.isNotNull() & ~F.exists(doubled, odd), whole)


def choose_pivots(vectors: DataFrame, width: int, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots from the ``sample`` vectors with the smallest digests, each the one farthest from those before.

    The sample is bounded, so what comes to the driver does not grow with the table. An empty table has one pivot.
    """
    rows = vectors.orderBy(F.xxhash64("vector"), "id").limit(sample).select("vector").collect()
    points = np.array([r.vector for r in rows] or [[0] * width], dtype=np.float64)
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """One component more, so that every vector has the squared length ``top``."""
    body = vectors.astype(np.float64)
    return np.c_[body, np.sqrt(np.maximum(top - (body * body).sum(1), 0))]


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in double precision where no sum can leave its whole numbers."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    if largest < 2.0**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**61:
        return queries @ vectors.T
    raise OverflowError("inner products of these vectors may exceed 64-bit integers")


def _most(distance: np.ndarray, length: np.ndarray, inner: np.ndarray, outer: np.ndarray, top: float) -> np.ndarray:
    """The highest score that queries can have with vectors between two distances from a pivot.

    ``distance`` is that of the lifted query (its new component is 0) from the pivot. By the triangle inequality the
    distance to the vector is at least the gap; its square is the query's length plus ``top`` less twice the score.
    """
    gap = np.maximum(np.maximum(inner - distance, distance - outer), 0)
    return (length + top - gap**2) / 2 + SLACK * (length + top) + 0.5


def _pivot_distance(queries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    body = np.c_[queries.astype(np.float64), np.zeros(len(queries))]
    return np.sqrt(_squares(body, pivots)), (body * body).sum(axis=1)


def _best(query: pa.Table, cell: pa.Table, k: int, top: float, pivot: np.ndarray) -> pa.Table:
    """For each query the ``k`` best rows of a part of a cell, as ``query``, ``id`` and ``score``.

    The rows are sorted by their distance from the pivot; annuli are runs of them. A query takes the annuli in the
    order of the highest score that the triangle inequality leaves to them and stops once that is below its bound or
    its k-th best so far. A row does not answer a query of its own id.
    """
    cell = cell.sort_by([("far", "ascending"), ("id", "ascending")])
    vectors, ids, far = _matrix(cell["vector"]), cell["id"].to_numpy(), cell["far"].to_numpy()
    asked, names = _matrix(query["vector"]), query["id"].to_numpy()
    bound = pc.fill_null(query["bound"], NONE).to_numpy().copy()
    starts = np.arange(0, len(ids), ANNULUS)
    ends = np.minimum(starts + ANNULUS, len(ids))
    distance, length = _pivot_distance(asked, pivot[None, :])
    most = _most(distance, length[:, None], far[starts][None, :], far[ends - 1][None, :], top)
    order = np.argsort(-most, axis=1, kind="stable")
    every = np.arange(len(names))
    scores, answers = np.full((len(names), k), NONE), np.full((len(names), k), NO_ID)
    for step in range(len(starts)):
        ring = order[:, step]
        going = most[every, ring] >= bound
        if not going.any():
            break
        for at in np.unique(ring[going]):
            who = np.flatnonzero(going & (ring == at))
            rows = ids[starts[at] : ends[at]]
            own = names[who][:, None] == rows[None, :]
            new = np.where(own, NONE, _products(asked[who], vectors[starts[at] : ends[at]]))
            all_scores = np.c_[scores[who], new]
            all_ids = np.c_[answers[who], np.where(own, NO_ID, rows[None, :])]
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_scores, pick, axis=1)
            answers[who] = np.take_along_axis(all_ids, pick, axis=1)
            bound[who] = np.maximum(bound[who], scores[who, -1])
    found = scores != NONE
    columns = [np.repeat(names, k)[found.ravel()], answers[found], scores[found]]
    return pa.table(dict(zip(("query", "id", "score"), map(pa.array, columns))))


def _keyed(vectors: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """``vectors`` with the nearest pivot's number ``cell`` and the distance to it, ``far``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                squares = _squares(_lift(_matrix(batch.column("vector")), top), pivots)
                cell = squares.argmin(axis=1).astype(np.int32)
                far = np.sqrt(squares[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return vectors.mapInArrow(run, "id bigint, vector array<bigint>, cell int, far double")


def _routed(queries: DataFrame, cells: dict[int, tuple[int, float, float]], pivots: np.ndarray, top: float) -> DataFrame:
    """Each query once for each part of each cell that can hold a score as good as its bound."""
    number = np.array(sorted(cells))
    inner, outer = (np.array([cells[c][i] for c in number]) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance, length = _pivot_distance(_matrix(batch.column("vector")), pivots[number])
                bound = pc.fill_null(batch.column("bound"), NONE).to_numpy()
                going = _most(distance, length[:, None], inner[None, :], outer[None, :], top) >= bound[:, None]
                wanted = pa.array([number[row].tolist() for row in going], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, wanted], [*batch.schema.names, "cells"])

    routed = queries.mapInArrow(run, "id bigint, vector array<bigint>, bound bigint, cells array<int>")
    parts = F.get(F.array(*[F.lit(cells.get(c, (0,))[0]) for c in range(len(pivots))]), F.col("cell"))
    return (
        routed.withColumn("cell", F.explode("cells"))
        .drop("cells")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )


def top_k(vectors: DataFrame, is_query: Column, k: int, pivot_count: int = PIVOTS) -> DataFrame:
    """``query``, ``rank`` (from 1), ``id`` and ``score`` of each query's ``k`` highest integer inner products.

    ``vectors`` has ``id`` (long) and ``vector`` (array of long); the queries are the rows for which ``is_query`` holds,
    the candidates all rows but those with the query's id. Ties go to the smaller id; with fewer candidates all are
    given. Rows with a null id or vector and vectors whose length is not the most frequent one take no part; queries
    that repeat an id are asked once; candidates that repeat an id are candidates of their own. An empty table gives
    no rows.

    A cell is cut by digest into parts of about ``CELL_ROWS`` rows, so many equal vectors are many parts. The first
    pass asks each query in its own part, which bounds its k-th score from below. The second asks blocks of queries in
    all parts that the bound does not rule out. The index and the bounds are written to the shared folder.
    """
    known = vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).select("id", "vector")
    widest = known.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = widest.width if widest else 1
    known = known.filter(F.size("vector") == width)
    square = F.aggregate("vector", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    top = known.agg(F.max(square)).first()[0] or 0.0
    pivots = _lift(choose_pivots(known, width, pivot_count), top)
    index = materialize(_keyed(known, pivots, top), "index")
    shape = index.groupBy("cell").agg(F.count(F.lit(1)), F.min("far"), F.max("far")).collect()
    cells = {c: (math.ceil(n / CELL_ROWS), low, high) for c, n, low, high in map(tuple, shape)}
    parts = F.get(F.array(*[F.lit(cells.get(c, (1,))[0]) for c in range(len(pivots))]), F.col("cell"))
    index = index.withColumn("part", F.pmod(F.xxhash64("id", "vector"), parts).cast("int")).withColumn("asks", is_query)

    def best(key: tuple[pa.Scalar, ...], asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(rows) or not len(asking):
            return ANSWER.empty_table()
        return _best(asking, rows, k, top, pivots[key[0].as_py()])

    answer = "query bigint, id bigint, score bigint"
    # The same vector of a repeated id in both passes, so that a bound counts each candidate row once.
    once = index.filter("asks").groupBy("id").agg(F.min(F.struct("vector", "cell", "part")).alias("own"))
    asked = materialize(once.select("id", "own.*", F.lit(None).cast("bigint").alias("bound")), "asked")
    seeds = index.select("id", "vector", "far", "cell", "part")
    first = asked.groupBy("cell", "part").cogroup(seeds.groupBy("cell", "part")).applyInArrow(best, answer)
    bounds = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    known_best = asked.drop("bound").join(bounds, F.col("id") == F.col("query"), "left")
    queries = materialize(known_best.select("id", "vector", "bound"), "queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = _routed(queries, cells, pivots, top).withColumn("block", block)
    right = seeds.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(best, answer)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "rank", "id", "score")
