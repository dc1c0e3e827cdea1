"""Files as rows."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import extension, relative_path
from ..functions.patterns import any_glob
from ..operators.ordered import sum_before
from ..session import materialize, qualified

# Leading bytes (hex) and file suffixes of image types.
IMAGE_MAGIC = (("FFD8FF", "image/jpg"), ("89504E47", "image/png"), ("474946", "image/gif"), ("424D", "image/bmp"))
IMAGE_SUFFIX = (
    (".jpg", "image/jpg"),
    (".jpeg", "image/jpg"),
    (".png", "image/png"),
    (".gif", "image/gif"),
    (".bmp", "image/bmp"),
)


#: Files beyond this size are rows without content: one file is one value.
MAX_FILE_BYTES = 512 << 20
#: What one task reads.
TASK_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
#: As no file is opened, files are listed in this many tasks per core at most.
LISTING_TASKS = 4


def list_files(spark: SparkSession, root: str, globs: Sequence[str] = ("**",)) -> DataFrame:
    """All files below ``root`` that a glob takes: ``path`` (relative), ``modified`` and ``length``.

    The root may be spelt in any way its file system takes (relative, with or without scheme and host). No file is
    opened; filters on ``length`` and ``modified`` reach the scan. Files that go while they are listed are left out.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    base = re.sub("^file:/+", "/", qualified(spark, root)).rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    files = raw.select(relative_path(plain, base).alias("path"), F.col("modificationTime").alias("modified"), "length")
    files = files.coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism)  # else each task names some 32 files
    return files if tuple(globs) == ("**",) else files.filter(any_glob(F.col("path"), globs))


def _packed(files: DataFrame, task_bytes: int) -> DataFrame:
    """Listed files dealt to tasks of about ``task_bytes``; a file that is larger has a task of its own."""
    size = F.least(F.col("length"), F.lit(task_bytes)) + 4096  # opening a file counts as reading a page
    placed = sum_before(files, [], ["path"], size, "__before").withColumn("__bin", F.floor(F.col("__before") / task_bytes))
    settled = materialize(placed.drop("__before"), "listing")
    bins = (settled.agg(F.max("__bin")).first()[0] or 0) + 1
    return settled.repartitionByRange(bins, "__bin").drop("__bin") if bins > 1 else settled.coalesce(1).drop("__bin")


def _reader(root: str, max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)

        def attempt(path: str, length: int) -> tuple[bytes | None, str | None]:
            if length > max_bytes:
                return None, f"{length} bytes are more than the {max_bytes} that are read"
            try:
                with system.open_input_stream(posixpath.join(base, path), buffer_size=1 << 16) as stream:
                    content = stream.read(max_bytes + 1)
            except Exception as caught:  # whatever is wrong with one file is told in its row
                return None, str(caught)
            if len(content) > max_bytes:
                return None, f"it grew beyond the {max_bytes} bytes that are read"
            return content, None

        for batch in batches:
            start, held, found = 0, 0, []
            for at, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())):
                found.append(attempt(path, length))
                held += len(found[-1][0] or b"")
                if held >= BATCH_BYTES or at == batch.num_rows - 1:
                    columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())]
                    names = [*batch.schema.names, "content", "error"]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, at + 1 - start).columns, *columns], names)
                    start, held, found = at + 1, 0, []

    return read


def read_content(
    spark: SparkSession, files: DataFrame, root: str, max_bytes: int = MAX_FILE_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Listed files with ``content`` and ``error``: what cannot be read is a row with null content and the reason.

    A file that is forbidden, gone since it was listed, or larger than ``max_bytes`` therefore ends no job. Files are dealt
    to tasks by their bytes, and a task hands on what it has read every few megabytes. Filter by name before reading.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    system, path = re.fullmatch(r"(\w+:(?://[^/]*)?)?(/.*)", qualified(spark, root).rstrip("/") + "/").groups()
    where = ("file://" if system in (None, "file:") else system) + quote(path.rstrip("/") or "/")
    return _packed(files, task_bytes).mapInArrow(_reader(where, max_bytes), schema)


def scan_files(spark: SparkSession, root: str, globs: Sequence[str] = ("**",), **options) -> DataFrame:
    """All files below ``root`` that a glob takes: ``path``, ``modified``, ``length``, ``content`` and ``error``."""
    return read_content(spark, list_files(spark, root, globs), root, **options)


def binary_flag(content: Column) -> Column:
    """Content with a NUL byte is binary."""
    return F.contains(content, F.lit(bytearray(b"\x00")))


def text_decode(content: Column) -> Column:
    """UTF-8 text; bytes that are not UTF-8 become U+FFFD and a leading byte order mark goes."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2147483647)).otherwise(text)


def image_type(path: Column, content: Column) -> Column:
    """Content type by leading bytes, else by suffix; null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    suffix, out = F.lower(extension(path)), None
    for magic, kind in IMAGE_MAGIC:
        cond = (F.octet_length(content) >= 4) & head.startswith(magic)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    for ext, kind in IMAGE_SUFFIX:
        out = out.when(suffix == ext, kind)
    return out


def decoded(files: DataFrame) -> DataFrame:
    """Files with ``is_binary`` and ``text``, which is null for binary content and for what could not be read."""
    files = files.withColumn("is_binary", F.coalesce(binary_flag(F.col("content")), F.lit(False)))
    return files.withColumn("text", F.when(~F.col("is_binary"), text_decode(F.col("content"))))


def read_files(spark: SparkSession, root: str, globs: Sequence[str] = ("**",), **options) -> DataFrame:
    """Scanned files with ``is_binary`` and ``text``."""
    return decoded(scan_files(spark, root, globs, **options))
