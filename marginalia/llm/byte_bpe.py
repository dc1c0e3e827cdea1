"""Byte-level BPE by longest matches and backtracking.

A token sequence is what the merges give exactly if every two neighbours in it are what the merges give for those
two alone. So a piece is encoded from left to right with the longest token that starts at each place, stepping to
the next shorter token where two neighbours do not go together and one token back where none is left. A place that
was given up is never entered again, so the work is linear in the piece. All tokens that occur are found in one pass
of an Aho-Corasick automaton over the bytes, mapped to Latin-1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import Memo, free_name, shared_state, text_chunks
from .pieces import piece_finder

MAX_RANK_FILE = 64 << 20
MEMO_PAIRS = 1 << 19


class RankError(ValueError):
    """The rank file does not hold a byte-level vocabulary."""


def read_ranks(path: str) -> bytes:
    """The rank file at ``path`` on the driver; its size is checked, as every executor gets a copy."""
    with open(path, "rb") as file:
        content = file.read(MAX_RANK_FILE + 1)
    if len(content) > MAX_RANK_FILE:
        raise RankError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return content


class Encoder:
    """Encodes pieces by the ranks of one file; tokens are held as Latin-1 strings of their bytes."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        if any(chr(byte) not in self.rank for byte in range(256)):
            raise RankError("a byte-level vocabulary has a token for each byte")
        top = max(self.rank.values()) + 1
        self.token = [""] * top
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.size = [len(token) for token in self.token]
        self.content = [token.encode("latin-1") for token in self.token]
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(token) for token in self.token]
        self.fits: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, int, int]]] = {}

    def _prefix(self, token: str) -> int:
        """The longest token that is a proper start of ``token``, -1 if there is none."""
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for single bytes and tokens that no merge gives."""
        if token not in self.parts:
            row = list(self.token[token])
            while len(row) > 2:
                rank, at = min((self.rank.get(a + b, len(self.token)), i) for i, (a, b) in enumerate(zip(row, row[1:])))
                if rank == len(self.token):
                    break
                row[at : at + 2] = [row[at] + row[at + 1]]
            self.parts[token] = (self.rank[row[0]], self.rank[row[1]]) if len(row) == 2 else None
        return self.parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[str, int, int]]:
        """What stands at one edge of ``token`` while it is being merged: (token, since which rank, until which)."""
        if (token, side) not in self.edges:
            row, until, part = [], len(self.token), token
            while (parts := self._last_merge(part)) is not None:
                row.append((self.token[part], part, until))
                until, part = part, parts[side]
            self.edges[token, side] = [*row, (self.token[part], -1, until)]
        return self.edges[token, side]

    def _merged(self, token: int) -> bool:
        return self.size[token] == 1 or self._last_merge(token) is not None

    def _go_together(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side, with no merge across their border.

        Tokens a and b at the border merge if they stand there at the rank of their union; of two equal ranks the
        left one goes first.
        """
        if not (self._merged(left) and self._merged(right)):
            return False
        for a, since_a, until_a in self._edge(left, 1):
            for b, since_b, until_b in self._edge(right, 0):
                union = self.rank.get(a + b)
                if union is not None and until_a > max(union, since_a, since_b) <= until_b:
                    return False
        return True

    def encode(self, piece: str) -> tuple[int, ...]:
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return (whole,)
        size, shorter, fits, base = self.size, self.shorter, self.fits, len(self.token)
        length = len(text)
        longest = [0] * length
        for end, token in self.automaton.iter(text):
            longest[end + 1 - size[token]] = token
        given_up = bytearray(length + 1)
        found: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            if given_up[end]:
                good = False
            elif last < 0:
                good = True
            else:
                good = fits.get(pair := last * base + token)
                if good is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    good = fits[pair] = self._go_together(last, token)
            if good:
                found.append(token)
                if end == length:
                    return tuple(found)
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            if token < 0:
                given_up[at] = 1
                token = found.pop()
                at -= size[token]
                last = found[-1] if found else -1


def encode(docs: DataFrame, ranks: bytes, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text (array of int), and with ``decoded`` the bytes these ids stand for.

    Each match of ``public_tokenizers.PATTERN`` is merged on its own; strings of special tokens are ordinary text. A
    null text counts as empty and gives no ids. All other columns stay; columns named ``ids`` or ``decoded`` are
    replaced; repeated rows stay repeated. One partition is read as a stream of bounded chunks, so a task holds one
    chunk of texts, the automaton and bounded memos, whatever the table's size.
    """
    kept = docs.select(*[c for c in docs.columns if c not in (ids, decoded) or c == text])
    source = text
    if text in (ids, decoded):
        source = free_name(docs.columns, "source_text")
        kept = kept.withColumnRenamed(text, source)
    shared = shared_state(docs.sparkSession, ranks=ranks)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        added.append(T.StructField(decoded, T.BinaryType(), False))
    out = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "encoder" not in state:
            state["encoder"] = Encoder(state["ranks"])
            state["memo"] = Memo(state["encoder"].encode)
        find, ids_of, content = piece_finder(), state["memo"].__getitem__, state["encoder"].content
        for chunk in text_chunks(batches, source):
            offsets, flat, back = [0], [], []
            for value in chunk.column(source).to_pylist():
                row = list(chain.from_iterable(map(ids_of, find(value or ""))))
                flat.append(np.array(row, dtype=np.int32))
                offsets.append(offsets[-1] + len(row))
                if decoded:
                    back.append(b"".join(map(content.__getitem__, row)))
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]
            if decoded:
                columns.append(pa.array(back, pa.binary()))
            yield pa.RecordBatch.from_arrays([*chunk.columns, *columns], [*chunk.schema.names, *[f.name for f in added]])

    return kept.mapInArrow(run, out)


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each array of ids stands for; null ids give null, an unknown id is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kept = rows.select(*[c for c in rows.columns if c != decoded or c == ids])
    out = T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, shared.value.splitlines())}
        for batch in batches:
            rows_of = batch.column(ids).to_pylist()
            back = [None if row is None else b"".join(map(content.__getitem__, row)) for row in rows_of]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, decoded])

    return kept.mapInArrow(run, out)
