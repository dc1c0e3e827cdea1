"""The line search over lines that arrive in batches, with context that reaches over batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.patterns import line_hit
from ..operators.line_rows import printed_rows
from ..spec import LineSpec

#: Sources are dealt to so many groups with a state each; a stream keeps the number its checkpoint began with.
BUCKETS = 1 << 12

_STATE = "sources binary, held binary"
_SOURCES = pa.schema(
    [("source", pa.string()), *((name, pa.int64()) for name in ("next", "last", "left", "block", "ring", "waiting"))]
)
_HELD = pa.schema([("idx", pa.int64()), ("line", pa.large_string()), ("hit", pa.bool_())])


def _packed(rows: Iterable[tuple], schema: pa.Schema) -> bytes:
    columns = list(zip(*rows)) or [()] * len(schema)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in pa.ipc.open_stream(pa.py_buffer(packed)).read_all().columns))


class _Source:
    """What is known of a source: the next line, the last one shown, lines still to show, its block, lines held."""

    __slots__ = ("next", "last", "left", "block", "ring", "waiting")

    def __init__(self, next: int = 0, last: int = -2, left: int = 0, block: int = 0) -> None:
        self.next, self.last, self.left, self.block = next, last, left, block
        self.ring: list[tuple[int, str]] = []
        self.waiting: dict[int, tuple[str, bool]] = {}

    def search(self, before: int, after: int) -> Iterator[tuple]:
        """Lines that can be shown by now, ``(idx, line, hit, starts, block)``."""
        context = before + after > 0
        while self.next in self.waiting:
            line, hit = self.waiting.pop(self.next)
            ready = []
            if hit:
                ready, self.ring, self.left = [*((i, text, False) for i, text in self.ring), (self.next, line, True)], [], after
            elif self.left:
                ready, self.left = [(self.next, line, False)], self.left - 1
            elif before:
                self.ring = [*self.ring, (self.next, line)][-before:]
            for i, text, is_hit in ready:
                starts = context and i != self.last + 1
                self.block += starts
                yield i, text, is_hit, starts, self.block if context else 1
                self.last = i
            self.next += 1
        if self.waiting:
            self.waiting = {i: w for i, w in self.waiting.items() if i > self.next}


def _read_sources(sources: bytes, held: bytes) -> dict[str | None, _Source]:
    found, lines = {}, _unpacked(held)
    for source, following, last, left, block, ring, waiting in _unpacked(sources):
        own = found[source] = _Source(following, last, left, block)
        own.ring = [(i, line) for i, line, _ in islice(lines, ring)]
        own.waiting = {i: (line, hit) for i, line, hit in islice(lines, waiting)}
    return found


def _written_sources(sources: dict[str | None, _Source]) -> tuple[bytes, bytes]:
    kept = ((name, s.next, s.last, s.left, s.block, len(s.ring), len(s.waiting)) for name, s in sources.items())
    held: list[tuple] = []
    for s in sources.values():
        held.extend((i, line, False) for i, line in s.ring)
        held.extend((i, line, hit) for i, (line, hit) in s.waiting.items())
    return _packed(kept, _SOURCES), _packed(held, _HELD)


def stream_context(lines: DataFrame, spec: LineSpec, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Kept lines ``(key, idx, line, hit, starts, block)`` of arriving ``(key, idx, line)``, ``idx`` dense from 0 per source.

    The state of a source is a ring of the last ``before`` lines that were not shown, how many lines are still to be shown
    after a hit, the last line shown, and lines that came before their turn, which wait for those that are missing. So the
    rows are those of ``context_lines`` and ``gap_blocks``, whatever batches the lines come in and in whichever order; a line
    that comes again is ignored. Nothing has to be flushed at the end: what is held is never shown without a later hit.

    Sources are dealt to ``buckets`` by a hash. A bucket is one group with one state, compressed, because a call of Python
    costs much more than the few lines of a usual source; a task holds the lines of one bucket in one batch.
    """
    key_type = lines.schema[key].dataType
    # As text a key passes pandas as it is, be it null or above 2^53.
    source = F.hex(key) if isinstance(key_type, T.BinaryType) else F.col(key).cast("string")
    flagged = lines.select(
        F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int").alias("bucket"),
        source.alias("source"),
        F.col("idx").cast("bigint").alias("idx"),
        "line",
        line_hit(F.col("line"), spec.include, spec.remove).alias("hit"),
    )
    before, after = spec.before, spec.after

    def search(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sources = _read_sources(*state.get) if state.exists else {}
        arrived = set()
        for batch in batches:
            for name, i, line, hit in zip(batch["source"], batch["idx"], batch["line"], batch["hit"]):
                if name not in sources:
                    sources[name] = _Source()
                sources[name].waiting.setdefault(int(i), (line, bool(hit)))
                arrived.add(name)
        shown = [(name, *row) for name in arrived for row in sources[name].search(before, after)]
        state.update(_written_sources(sources))
        yield pd.DataFrame(shown, columns=["source", "idx", "line", "hit", "starts", "block"], dtype=object)

    kept = "source string, idx bigint, line string, hit boolean, starts boolean, block bigint"
    found = flagged.groupBy("bucket").applyInPandasWithState(search, kept, _STATE, "append", GroupStateTimeout.NoTimeout)
    named = F.unhex("source") if isinstance(key_type, T.BinaryType) else F.col("source").cast(key_type)
    return found.select(named.alias(key), "idx", "line", "hit", "starts", "block")


def stream_lines(lines: DataFrame, spec: LineSpec, key: str = "doc_id", ticks: Column | None = None) -> DataFrame:
    """Printed pieces ``(key, idx, piece, out)`` of arriving lines, as ``grep_rows`` gives them for lines at rest."""
    return printed_rows(stream_context(lines, spec, key), spec, [key], ticks)
