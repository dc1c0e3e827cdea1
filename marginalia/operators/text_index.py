"""An index of page text for many searches at once.

Every run of three characters of a page, and every one or two, has its pages as postings. A query looks up the rarest
run of its terms only, and the pages found for any query are then tested for the terms of all, each term once, as they are.
A query with a run that occurs nowhere has no page, and no text is read for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, work_folder
from .joins import join_keys

GRAM = 3
#: Postings and texts are stored in this many folders each, so that a search reads those it needs.
FOLDERS = 64
#: Postings that a task hands on at once, or those of one page.
BATCH_RUNS = 1 << 17
#: Queries that a task of the search holds at once, and pages it gets, at most and, where there are few, at least.
BLOCK, SHARE_PAGES, LEAST_PAGES = 1 << 17, 1 << 12, 1 << 7
#: Bytes of pages looked through at once, and pairs of a page and a query or term.
CHUNK, CELLS = 1 << 18, 1 << 20


class TextIndex(NamedTuple):
    """``pages (part, page_id, url, body)``, ``postings (head, gram, page_id)`` and ``counts (gram, pages)``."""

    pages: DataFrame
    postings: DataFrame
    counts: DataFrame


def _folder_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FOLDERS)).cast("int")


def _chars(text: Column) -> Column:
    """The characters of a text, so that a run is found by its place without counting from the start of the text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _runs(chars: Column, size: Column) -> Column:
    starts = F.when(F.size(chars) >= size, F.sequence(F.lit(1), F.size(chars) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(chars, k, size), ""))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different runs of up to ``GRAM`` characters of each body, some rows at a time."""
    for batch in batches:
        at, runs = [], []
        for row, body in enumerate(batch.column("body").to_pylist()):
            # The empty run stands for queries without a term, which every page answers.
            own, longer = {"", *body}, body
            for n in range(1, GRAM):
                longer = list(map(add, longer, body[n:]))
                own.update(longer)
            at.extend([row] * len(own))
            runs.extend(own)
            if len(runs) >= BATCH_RUNS or row == batch.num_rows - 1:
                ids = batch.column("page_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs, pa.string())], ["page_id", "gram"])
                at, runs = [], []


def query_terms(query: Column) -> Column:
    """The different terms of a query; it is split at white space as ``str.split`` does it for ASCII."""
    return F.array_distinct(F.filter(F.split(query, r"[\x09-\x0D\x1C-\x20]+"), lambda t: t != ""))


def build_index(pages: DataFrame, text: str = "text", folder: str | None = None, ignore_case: bool = True) -> TextIndex:
    """Write the index of ``pages (page_id, url, text)`` to ``folder``, by default a work folder of the session.

    Null texts are indexed as empty. Postings are written by the tasks that find them, a file for each folder and some
    thousand pages, so those of a frequent run are many files. Page ids tell pages apart; rows that share one are one posting but are tested each.
    """
    spark = pages.sparkSession
    root = folder or work_folder(spark, "text-index")
    body = F.coalesce(F.col(text), F.lit(""))
    body = F.lower(body) if ignore_case else body
    stored = pages.select(_folder_of(F.col("page_id")).alias("part"), "page_id", "url", body.alias("body"))
    stored.write.mode("overwrite").partitionBy("part").parquet(f"{root}/pages")
    kept = spark.read.parquet(f"{root}/pages")
    id_type = kept.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", id_type), T.StructField("gram", T.StringType())])
    tasks = max(-(-kept.count() // SHARE_PAGES), 2 * spark.sparkContext.defaultParallelism)
    rows = kept.select("page_id", F.make_valid_utf8("body").alias("body")).coalesce(tasks).mapInArrow(_postings, schema)
    if not kept.groupBy("page_id").count().filter("count > 1").isEmpty():
        rows = rows.distinct()
    headed = rows.withColumn("head", _folder_of(F.col("gram")))
    headed.write.mode("overwrite").partitionBy("head").parquet(f"{root}/postings")
    postings = spark.read.parquet(f"{root}/postings")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("pages")).write.mode("overwrite").parquet(f"{root}/counts")
    return open_index(spark, root)


def open_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("pages", "postings", "counts")))


def rarest_grams(index: TextIndex, queries: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``(query, terms, gram)``: the run to look up for each different query; queries that can have no page are left out."""
    text = F.lower("query") if ignore_case else F.col("query")
    asked = queries.select("query").filter(F.col("query").isNotNull()).distinct().withColumn("terms", query_terms(text))
    every = F.array_distinct(F.flatten(F.transform("terms", lambda t: _runs(_chars(t), F.least(F.length(t), F.lit(GRAM))))))
    rows = asked.withColumn("gram", F.explode(F.when(F.size("terms") == 0, F.array(F.lit(""))).otherwise(every)))
    known = rows.join(index.counts, "gram", "left")
    rarity = F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "gram")
    first = known.groupBy("query").agg(F.min(rarity).alias("rarest"), F.any_value("terms").alias("terms"))
    return first.filter("rarest.pages > 0").select("query", "terms", F.col("rarest.gram").alias("gram"))


def search_index(index: TextIndex, queries: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``(query, page_id, url)`` of all pages that hold all terms of a query, for a table of queries ``(query)``.

    Queries are data here: their number is not limited, a repeated one is searched once, null ones have no page. Runs and
    candidates, the pages that hold the run of any query, are written out: only the folders of their postings and pages are
    read. A candidate is then read once for each ``BLOCK`` of queries and looked through once for the terms of all of them, so
    work grows with the pages and with what is found; pairs of a query and a page that do not meet are never rows.
    """
    looked_up = rarest_grams(index, queries, ignore_case).withColumn("head", _folder_of(F.col("gram")))
    looked_up = materialize(looked_up, "grams")
    # Runs meet on their hashes, which are faster to look up; a page too many would do no harm, as it is tested.
    code = F.xxhash64("gram").alias("code")
    postings = _folders(index.postings, looked_up, "head").select("page_id", code)
    found = postings.join(looked_up.select(code).distinct(), "code", "left_semi").select("page_id").distinct()
    candidates = materialize(found.withColumn("part", _folder_of(F.col("page_id"))), "candidates")
    number = candidates.count()
    if not number:
        return candidates.select(F.lit("").alias("query"), "page_id", F.lit("").alias("url"))
    texts = join_keys(_folders(index.pages, candidates, "part"), candidates.drop("part"), ["page_id"], "left_semi")
    return _meet(texts, looked_up, number, -(-looked_up.count() // BLOCK))


def _meet(texts: DataFrame, asked: DataFrame, number: int, blocks: int) -> DataFrame:
    """``(query, page_id, url)`` of ``texts (page_id, url, body)`` that hold all terms of ``asked (query, terms)``.

    A task gets a share of the pages behind a block of the queries, sorted so that it holds these and sees the pages pass.
    """
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    shares = max(-(-number // SHARE_PAGES), min(-(-number // LEAST_PAGES), 2 * tasks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(shares))
    pages = texts.select("page_id", "url", F.col("body").cast("binary").alias("body"), share.alias("share"), every(blocks).alias("block"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    dealt = asked.select("query", F.col("terms").cast("array<binary>").alias("terms"), block.alias("block"), every(shares).alias("share"))
    rows = pages.withColumn("is_page", F.lit(1)).unionByName(dealt.withColumn("is_page", F.lit(0)), allowMissingColumns=True)
    slot = F.col("block") * shares + F.col("share")
    turns = rows.select(slot.alias("slot"), (slot * 2 + F.col("is_page")).alias("turn"), "page_id", "url", "body", "query", "terms")
    sorted_rows = turns.repartition(max(2, blocks * shares), "slot").sortWithinPartitions("turn").drop("slot")
    fields = [texts.schema["page_id"], texts.schema["url"], T.StructField("found", T.ArrayType(T.StringType()))]
    answers = sorted_rows.mapInArrow(lambda batches: _answers(batches, shares), T.StructType(fields))
    return answers.select(F.explode("found").alias("query"), "page_id", "url")


def _answers(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Pages with the queries they answer; rows come in the order of ``turn``, which is even for queries, odd for pages.

    A block of queries stands before each share of pages; it is taken where it comes first.
    """
    block, taken, parts, asked = None, None, [], None
    for batch in batches:
        turns = batch.column("turn").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1), len(turns)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            slot, is_page = divmod(int(turns[start]), 2)
            if slot // shares != block:
                block, taken, parts, asked = slot // shares, slot, [], None
            rows = batch.slice(start, end - start)
            if not is_page:
                if slot == taken:
                    parts.append(rows.select(["query", "terms"]))
            elif parts:
                asked = asked or _Asked(pa.Table.from_batches(parts).combine_chunks())
                yield from asked.answers(rows)


class _Asked:
    """A block of queries, which finds those that a page answers by one look through its bytes.

    The different terms are told by their first bytes, up to 8 as a number: for each length a table says which numbers can
    be one, and those of a page that can are looked up among the sorted numbers of the terms. Longer terms are compared.
    """

    def __init__(self, rows: pa.Table) -> None:
        terms = rows.column("terms").combine_chunks()
        counts = np.diff(terms.offsets.to_numpy())
        numbers: dict[bytes, int] = {}
        flat = np.array([numbers.setdefault(t, len(numbers)) for t in terms.flatten().to_pylist()], np.int64)
        starts, order = np.cumsum(counts) - counts, np.argsort(counts, kind="stable")
        self.queries = rows.column("query").combine_chunks().take(pa.array(order))
        #: For each number of terms how many queries have it and their first, second, ... terms.
        self.terms_of = []
        for count in np.unique(counts):
            own = starts[order[counts[order] == count]]
            self.terms_of.append((len(own), [flat[own + k] for k in range(count)]))
        self.terms = list(numbers)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        self.sizes = sizes
        word = lambda part: int.from_bytes(part, "little")
        first = np.array([word(t[:8]) for t in self.terms], np.uint64)
        self.last = np.array([word(t[-8:]) for t in self.terms], np.uint64)
        self.tables = []
        for size in range(1, 9):
            own = np.flatnonzero(sizes == size if size < 8 else sizes >= 8)
            if len(own):
                own = own[np.argsort(first[own], kind="stable")]
                bits = int(min(20, max(8, len(own).bit_length() + 4)))
                can_be = np.zeros(1 << bits, bool)
                can_be[_mixed(first[own], bits)] = True
                self.tables.append((size, bits, can_be, first[own], own))

    def answers(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bodies = rows.column("body").to_pylist()
        most = max(1, CELLS // (len(self.terms) + len(self.queries) + 1))
        start = 0
        while start < len(bodies):
            end, size = start, 0
            while end < len(bodies) and end - start < most and (end == start or size + len(bodies[end]) <= CHUNK):
                size += len(bodies[end])
                end += 1
            meets = self._meets(bodies[start:end])
            at, found = np.nonzero(meets)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=end - start))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.queries.take(pa.array(found)))
            own = rows.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), lists], ["page_id", "url", "found"])
            start = end

    def _meets(self, bodies: list[bytes]) -> np.ndarray:
        """Which page answers which query."""
        held = self._held(bodies)
        meets = np.ones((len(bodies), len(self.queries)), bool)
        at = 0
        for number, terms in self.terms_of:
            for of in terms:
                meets[:, at : at + number] &= held[:, of]
            at += number
        return meets

    def _held(self, bodies: list[bytes]) -> np.ndarray:
        """Which page holds which term."""
        held = np.zeros((len(bodies), len(self.terms)), bool)
        data = b"".join(bodies)
        every = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
        ends = np.cumsum([len(b) for b in bodies])
        for start in range(0, len(data), CHUNK):
            words = every[start : start + CHUNK].astype(np.uint64)
            places = np.arange(start, start + len(words))
            page = np.searchsorted(ends, places, "right")
            left = ends[page] - places
            for size, bits, can_be, keys, own in self.tables:
                key = words & np.uint64((1 << 8 * size) - 1)
                at = np.flatnonzero(can_be[_mixed(key, bits)] & (left >= size))
                low = np.searchsorted(keys, key[at])
                same = keys[np.minimum(low, len(keys) - 1)] == key[at]
                at, low = at[same], low[same]
                if size < 8:
                    held[page[at], own[low]] = True
                    continue
                number = np.searchsorted(keys, key[at], "right") - low
                step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                at, term = np.repeat(at, number), own[np.repeat(low, number) + step]
                fits = left[at] >= self.sizes[term]
                at, term = at[fits], term[fits]
                fits = every[start + at + self.sizes[term] - 8] == self.last[term]
                at, term = at[fits], term[fits]
                short = self.sizes[term] <= 16
                held[page[at[short]], term[short]] = True
                for k, t in zip(at[~short].tolist(), term[~short].tolist()):
                    if not held[page[k], t]:
                        held[page[k], t] = data.startswith(self.terms[t], start + k)
        return held


def _mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _folders(stored: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The folders of a stored table that ``wanted`` names; there are ``FOLDERS`` of them at most."""
    named = [row[0] for row in wanted.select(column).distinct().collect()]
    return stored.filter(F.col(column).isin(named))
