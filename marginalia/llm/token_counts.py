"""Token counts of a byte-level BPE model by merging with a heap over a linked list.

The bytes of a piece form a linked list of symbols. A heap holds the adjacent pairs that can merge, by rank and then
by place. The lowest pair is merged into its left symbol, the pairs with the two new neighbours enter the heap, and
entries whose symbols have changed meanwhile are passed over. The count is the number of bytes less the number of
merges; no identifiers are made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Memo, free_name, shared_state, text_chunks
from .pieces import piece_finder

MAX_MODEL_FILE = 64 << 20


class ModelError(ValueError):
    """The file is not a byte-level BPE model of the supported form."""


def read_model(path: str) -> dict[str, list]:
    """Merges and special strings of a byte-level model file, read on the driver and checked for its size and form."""
    with open(path, "rb") as file:
        content = file.read(MAX_MODEL_FILE + 1)
    if len(content) > MAX_MODEL_FILE:
        raise ModelError(f"{path} is larger than {MAX_MODEL_FILE} bytes")
    spec = json.loads(content)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    if not plain or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or spec.get("normalizer"):
        raise ModelError(f"{path} is not a plain byte-level BPE model")
    if cut.get("add_prefix_space") or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ModelError(f"{path} asks for prefix spaces or special tokens that take their surroundings")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"]]}


def byte_letters() -> list[str]:
    """The character that stands for each byte in the model file.

    Visible Latin-1 characters stand for themselves; the others, in order, for the characters from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(byte if byte in visible else next(hidden)) for byte in range(256)]


class Counter:
    """Counts the tokens of pieces; symbols are the strings that the model's merges are written in."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        self.rank: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(merges):
            self.rank.setdefault(pair, rank)
        self.letters = dict(enumerate(byte_letters()))
        self.same = re.compile("[!-~]*").fullmatch

    def count(self, piece: str) -> int:
        rank_of = self.rank.get
        text = piece if self.same(piece) else piece.encode().decode("latin-1").translate(self.letters)
        symbols: list[str | None] = list(text)
        n = left = len(symbols)
        # An entry is rank * n + place, so that the lowest rank comes first and, of equal ranks, the leftmost place.
        heap = [rank * n + at for at, pair in enumerate(zip(text, text[1:])) if (rank := rank_of(pair)) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            at = entry % n
            other = after[at]
            if other == n or (first := symbols[at]) is None:
                continue
            second = symbols[other]
            if rank_of((first, second)) != entry // n:
                continue
            merged = symbols[at] = first + second
            symbols[other] = None
            left -= 1
            following = after[at] = after[other]
            if following < n:
                before[following] = at
                if (rank := rank_of((merged, symbols[following]))) is not None:
                    heappush(heap, rank * n + at)
            if (previous := before[at]) >= 0 and (rank := rank_of((symbols[previous], merged))) is not None:
                heappush(heap, rank * n + previous)
        return left


def _splitter(special: list[str]) -> Callable[[str], list[str]] | None:
    """Cuts a text at special strings, the longest first where several start at one place."""
    if not special:
        return None
    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))).split


def count_tokens(
    docs: DataFrame, model: dict[str, list], text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the UTF-8 bytes and the number of tokens of each text (long).

    A special string of the model that occurs in a text is one token; no begin or end tokens are added, nothing is cut
    or padded. A null text counts as empty: 0 bytes, 0 tokens. All other columns stay, columns named as the two results
    are replaced, repeated rows stay repeated. A task reads bounded chunks of texts, whatever the table's size.
    """
    clash = text in (n_bytes, n_tokens)
    source = free_name(docs.columns, "source_text") if clash else text
    named = docs.withColumnRenamed(text, source) if clash else docs
    kept = named.select(*[c for c in named.columns if c not in (n_bytes, n_tokens)])
    shared = shared_state(docs.sparkSession, merges=model["merges"], special=model["special"])
    out = T.StructType([*kept.schema.fields, T.StructField(n_tokens, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "memo" not in state:
            state["memo"] = Memo(Counter(state["merges"]).count)
        find, count_of, split = piece_finder(), state["memo"].__getitem__, _splitter(state["special"])

        def count(value: str | None) -> int:
            if not value:
                return 0
            parts = split(value) if split else [value]
            return len(parts) - 1 + sum(sum(map(count_of, find(part))) for part in parts)

        for chunk in text_chunks(batches, source):
            counts = pa.array(map(count, chunk.column(source).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*chunk.columns, counts], [*chunk.schema.names, n_tokens])

    size = F.coalesce(F.octet_length(F.col(source)), F.lit(0)).cast("bigint")
    return kept.mapInArrow(run, out).withColumn(n_bytes, size)
