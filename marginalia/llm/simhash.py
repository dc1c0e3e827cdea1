"""Near duplicates by SimHash fingerprints and a hierarchical index in Gray order.

Fingerprints that link agree on one of three blocks of bits, as they differ in two bits at most, so each fingerprint
enters one bucket per block. A bucket that is too full is cut again by its remaining bits in the same way. Within a
bucket the fingerprints are sorted by Gray rank, so neighbours share most bits. Groups of neighbours become nodes
that hold the bits on which all below agree; the search from the top down adds up the differences on bits that are
new in each node and drops a whole group once there are too many.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .batches import free_name, text_chunks
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
MAX_DIFFERENCE = 2
FANOUT = 8
MAX_BUCKET = 1000
LEVELS = 3
QUERY_CHUNK = 1024
COUNT_CHUNK = 1 << 16
SIGN = -(1 << 63)


def fingerprint(text: str | None) -> int:
    """The SimHash of the 3-word shingles of a text, A-Z lower-cased; 0 without words.

    A bit is set if it is set in more than half of the shingles' hashes, repeats included. A text with fewer words is
    one shingle.
    """
    lower = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    # Without an argument, bytes are split at exactly the ASCII white space that separates words here.
    words = (text or "").encode().translate(lower).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.dtype("<u8"), n)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, COUNT_CHUNK):
        part = hashes[start : start + COUNT_CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``key`` and the fingerprint of each text as a (signed) long; a null text counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            marks = np.fromiter(map(fingerprint, chunk.column("text").to_pylist()), np.uint64, chunk.num_rows)
            yield pa.RecordBatch.from_arrays([chunk.column("key"), pa.array(marks.view(np.int64))], ["key", "mark"])

    return rows.mapInArrow(run, f"key {kind}, mark bigint").select(F.col("key").alias(key), F.col("mark").alias(name))


def gray_rank(code: Column) -> Column:
    """The place of a code in the order in which neighbours differ in one bit, as a long that sorts like it."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(SIGN))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(levels: int = LEVELS) -> list[dict[int, list[int]]]:
    """For each level, the masks that take the place of each mask of the level before (at first, of no bits).

    The bits outside a mask are cut into one block more than there may be differences, so two codes that agree on the
    mask and differ in few bits agree on one of the blocks as well.
    """
    out, now = [], [0]
    for _ in range(levels):
        step = {}
        for mask in now:
            free = [bit for bit in range(BITS) if not mask >> bit & 1]
            cuts = [len(free) * k // (MAX_DIFFERENCE + 1) for k in range(MAX_DIFFERENCE + 2)]
            step[mask] = [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]
        out.append(step)
        now = [mask for masks in step.values() for mask in masks]
    return out


def _bucketed(codes: DataFrame, max_bucket: int) -> DataFrame:
    """``(mask, value, code)``: each code once for each bucket in which it is to be compared.

    Buckets of one code are left out. A bucket of more than ``max_bucket`` codes is replaced by its children, down to
    the last level, where the bits left over bound its size.
    """
    parts, waiting = [], codes.select(F.lit(0).cast("bigint").alias("mask"), "code")
    masks = block_masks()
    for level, step in enumerate(masks):
        children = F.coalesce(
            *[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(c)) for c in kids])) for m, kids in step.items()]
        )
        rows = waiting.select(F.explode(children).alias("mask"), "code")
        if level:  # children of different masks can be alike
            rows = rows.distinct()
        rows = rows.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        placed = materialize(rows.join(sizes, ["mask", "value"]), "buckets")
        full = F.col("n") > max_bucket if level + 1 < len(masks) else F.lit(False)
        parts.append(placed.filter(~full).select("mask", "value", "code"))
        waiting = placed.filter(full).select("mask", "code")
        if level + 1 < len(masks) and waiting.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


class GrayIndex:
    """A forest over codes that are sorted by bucket and by Gray rank within it.

    The nodes of a level group ``FANOUT`` nodes of the level below; every bucket has one node on the top level. A node
    holds the bits on which all codes below it agree (``mask``) and their values (``bits``).
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray) -> None:
        self.codes = codes
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(codes, full, np.arange(len(codes)), np.arange(1, len(codes) + 1))]
        owner = bucket
        while True:
            bits, mask, first, _ = self.levels[-1]
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
            heads = np.flatnonzero(place % FANOUT == 0)
            every = np.bitwise_and.reduceat(mask, heads)
            alike = every & ~(np.bitwise_or.reduceat(bits & np.repeat(every, np.diff(np.r_[heads, len(bits)])), heads)
                              ^ np.bitwise_and.reduceat(bits | ~np.repeat(every, np.diff(np.r_[heads, len(bits)])), heads))
            owner = owner[heads]
            self.levels.append((bits[heads] & alike, alike, heads, np.r_[heads[1:], len(bits)]))
            if len(np.unique(owner)) == len(owner):
                break
        self.top_of = np.searchsorted(owner, bucket)

    def links(self, start: int, stop: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (query before partner) that differ in ``most`` bits at most, queries from start to stop."""
        query = np.arange(start, stop)
        node = self.top_of[query]
        bits, mask, first, end = self.levels[-1]
        seen = np.bitwise_count((self.codes[query] ^ bits[node]) & mask[node]).astype(np.int64)
        for below in range(len(self.levels) - 2, -1, -1):
            good = seen <= most
            query, node, seen = query[good], node[good], seen[good]
            sizes = end[node] - first[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            query, seen, known = np.repeat(query, sizes), np.repeat(seen, sizes), np.repeat(mask[node], sizes)
            bits, mask, first, end = self.levels[below]
            node = child
            seen = seen + np.bitwise_count((self.codes[query] ^ bits[node]) & mask[node] & ~known)
        good = (seen <= most) & (query < node)
        return query[good], node[good]


def _least_partner(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that it is linked to, directly or not."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _links_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links that span each bucket's components; rows arrive sorted, and a bucket may go over several batches."""

    def search(table: pa.Table) -> pa.RecordBatch:
        codes = table.column("code").to_numpy().view(np.uint64)
        mask, value = table.column("mask").to_numpy(), table.column("value").to_numpy()
        bucket = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        index = GrayIndex(codes, bucket)
        found = [index.links(at, min(at + QUERY_CHUNK, len(codes)), most) for at in range(0, len(codes), QUERY_CHUNK)]
        low = _least_partner(len(codes), *(np.concatenate(side) for side in zip(*found)))
        linked = np.flatnonzero(low != np.arange(len(codes)))
        pair = [codes[linked].view(np.int64), codes[low[linked]].view(np.int64)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, pair)), ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        mask, value = batch.column("mask").to_numpy(), batch.column("value").to_numpy()
        last = int(np.argmax((mask == mask[-1]) & (value == value[-1])))
        if last == 0 and held:
            before = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0]
            if (before["mask"], before["value"]) == (mask[-1], value[-1]):
                held.append(batch)
                continue
        if complete := [*held, *([batch.slice(0, last)] if last else [])]:
            yield search(pa.Table.from_batches(complete))
        held = [batch.slice(last)]
    if held:
        yield search(pa.Table.from_batches(held))


def links(codes: DataFrame, most: int = MAX_DIFFERENCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between different codes whose components are those of all links of ``most`` bits or fewer.

    ``codes`` has the column ``code``, different longs. Within a bucket the links are given as a star per component
    (each code with the least of its component), so a bucket of n codes gives fewer than n edges.
    """
    if most > MAX_DIFFERENCE:
        raise ValueError(f"buckets are made for {MAX_DIFFERENCE} differing bits at most")
    rows = _bucketed(codes, max_bucket).withColumn("rank", gray_rank(F.col("code")))
    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "rank").drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links_of(batches, most)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (long) and ``component`` (the smallest key reachable over links).

    Documents with one fingerprint are linked, and so are fingerprints that differ in two bits at most. Null and
    empty texts have fingerprint 0 and are linked like any other. A null key is no candidate for the smallest one (a
    component of null keys has a null component). Repeated rows stay repeated; an empty table gives no rows.

    Copies count once in the index, whatever their number; buckets are bounded by ``max_bucket``; fingerprints are
    written once to the shared folder.
    """
    marked = materialize(fingerprints(docs, key, text).withColumnRenamed(key, "key"), "fingerprints")
    codes = materialize(marked.groupBy(F.col("fingerprint").alias("code")).agg(F.min("key").alias("low")), "codes")
    stars = components(links(codes.select("code"), max_bucket=max_bucket))
    rooted = codes.join(stars.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_code = rooted.join(smallest, "root").select(F.col("code").alias("fingerprint"), "component")
    joined = marked.join(of_code, "fingerprint")
    return joined.select(F.col("key").alias(key), "fingerprint", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key, null keys last.

    Rows are told apart by a number that is written with them, not by their key: of rows that share a key those in
    one component are one group, those with other texts stay, and rows without a key are compared like any other. Of rows
    equal in component and key one stays.
    """
    row, wanted = free_name(docs.columns, "row"), free_name(docs.columns, "kept_row")
    # Hash tables of rows grow with the documents, so the rows kept are merged, not broadcast, whatever their number.
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates(numbered.select(row, F.col(text).alias("text")), row, "text").select(row, "component")
    keyed = judged.join(numbered.select(row, F.col(key).alias("key")).hint("merge"), row)
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", row))
    kept = materialize(keyed.groupBy("component").agg(first.alias("first")).select(F.col("first")[row].alias(wanted)), "kept")
    return numbered.join(kept.hint("merge"), F.col(row) == F.col(wanted), "left_semi").drop(row)
