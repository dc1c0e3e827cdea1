"""What the operators on Arrow batches share: bounded chunks of text, bounded memos, values kept by a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

CHUNK_BYTES = 4 << 20
MEMO_PIECES = 1 << 18
MEMO_LENGTH = 64


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column`` each; one longer text is a slice of its own.

    What a task holds of a batch besides Spark's own copy then does not follow the number of rows in it.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def shared_state(spark: SparkSession, **values: object) -> Broadcast[dict[str, object]]:
    """A broadcast dict of built-in values of bounded size.

    A Python worker keeps its copy from task to task, so what tasks add to the dict (an automaton, a bounded memo)
    is made once per worker and not once per task.
    """
    return spark.sparkContext.broadcast(dict(values))


class Memo(dict):
    """Results by piece; emptied when full, and long pieces are not kept, so that its size is bounded."""

    def __init__(self, function: Callable[[str], object], most: int = MEMO_PIECES, length: int = MEMO_LENGTH) -> None:
        super().__init__()
        self.function, self.most, self.length = function, most, length

    def __missing__(self, piece: str) -> object:
        result = self.function(piece)
        if len(piece) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[piece] = result
        return result


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name
