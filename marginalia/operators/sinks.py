"""Write outputs: per item, combined in order, as chat history."""

from __future__ import annotations

import os
import posixpath
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import template_path
from ..session import qualified, shared_folder
from .names import unique_slug

# Default output names.
FILE_TEMPLATE = "{filePath}/{fileBase}-output.md"
PAGE_TEMPLATE = "{filePath}/{fileBase}-output.md"
HISTORY_TEMPLATE = "chat-history-{time}.jsonl"
REPORT_NAME = "output.md"
COPY_BYTES = 8 << 20


def output_paths(items: DataFrame, template: str, timestamp: str, time: str, path: str = "path") -> DataFrame:
    return items.withColumn("out_path", template_path(F.col(path), template, timestamp, time))


def check_distinct_paths(items: DataFrame) -> None:
    """Two items for one output path are an error that names the first paths and their number; paths alone are counted."""
    twice = items.groupBy("out_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared, first = twice.agg(F.count(F.lit(1)), F.min("out_path")).first()
    if shared:
        raise ValueError(f"several items share an output path: {shared} paths, the first is {first}")


def _write_files(root: str):
    def write(batches: Iterator) -> Iterator:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = None
        for batch in batches:
            for path, content in zip(batch["out_path"], batch["content"]):
                target = posixpath.normpath(posixpath.join(base, path))
                if not target.startswith(base.rstrip("/") + "/"):
                    raise ValueError(f"output path leaves the target folder: {path}")
                if (folder := posixpath.dirname(target)) != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                fresh = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(fresh) as stream:
                    stream.write((content or "").encode("utf-8"))
                system.move(fresh, target)
            yield batch[["out_path"]]

    return write


def shared_root(spark: SparkSession, root: str) -> str:
    """``root`` with scheme and host; a local folder counts as shared only where driver and executors are one machine."""
    full = qualified(spark, root)
    if full.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        named = shared_folder(spark).removeprefix("file://").removeprefix("file:")
        if not full.removeprefix("file:").lstrip("/").startswith(named.strip("/") + "/"):
            raise ValueError(f"{full} is a folder of each executor; name one that all executors share")
    return full.replace("file:/", "file:///", 1) if re.match("file:/[^/]", full) else full


def save_per_item(items: DataFrame, root: str, as_files: bool = False) -> None:
    """Rows ``(out_path, content)`` to a parquet table, or to one file each below ``root``.

    Files are written whole under a passing name and then moved, so a task that runs again replaces them. A root
    without a scheme is on the default file system, in both forms; the disk of single executors is refused.
    """
    check_distinct_paths(items)
    rows = items.select("out_path", "content")
    if as_files:
        written = rows.mapInPandas(_write_files(shared_root(items.sparkSession, root)), "out_path string")
        written.write.format("noop").mode("overwrite").save()
    else:
        rows.write.mode("overwrite").parquet(root)


def save_pages(
    pages: DataFrame,
    root: str,
    content: Column,
    folder: str = "web-pages",
    as_files: bool = False,
    template: str | None = None,
    timestamp: str = "",
    time: str = "",
) -> None:
    """Page texts under names made from their URLs, or under what a template makes of these names."""
    named = unique_slug(pages.withColumn("content", content), folder)
    path = F.col("name") if template is None else template_path(F.col("name"), template, timestamp, time)
    save_per_item(named.withColumn("out_path", path), root, as_files)


def save_combined(items: DataFrame, target: str, order: Sequence[str], out: str = "out") -> None:
    """One report in order: part files that, read in name order, are the report.

    Rows are cut into ordered ranges, so every task writes its stretch, at any size.
    """
    ordered = items.select(*order, F.col(out).alias("value")).orderBy(*order)
    ordered.select("value").write.mode("overwrite").text(target)


def _copy_parts(target: str):
    """Copies parts ``(path, start)`` into a file that exists, each from its place on."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open(path, "rb") as part, open(target, "r+b") as whole:
                    whole.seek(start)
                    shutil.copyfileobj(part, whole, COPY_BYTES)
                    whole.flush()
                    os.fsync(whole.fileno())
            yield batch

    return copy


def save_report(items: DataFrame, target: str, order: Sequence[str], out: str = "out") -> None:
    """One report in order as one file: the items' texts, joined by newlines.

    Items are written as ordered part files, by all tasks; the sizes of these give each its place in the whole. Where the
    file system can join files (``concat``), that is one step without reading; on a folder that all machines share, tasks
    copy the parts side by side into the file. Either way the file is made under a passing name and then takes the place of
    ``target`` at once: a run that fails leaves the target as it was, and a run that is repeated replaces it. A null text
    is an empty one, no items make an empty file. Stores that can do neither get a folder from ``save_combined``.
    """
    spark = items.sparkSession
    full = shared_root(spark, target)
    folder = f"{full}.{uuid.uuid4().hex}.parts"
    jvm = spark.sparkContext._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    system = path_of(full).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        save_combined(items, folder, order, out)
        listed = sorted((f.getPath().getName(), f.getLen()) for f in system.listStatus(path_of(folder)))
        parts = [(name, size) for name, size in listed if name.startswith("part-") and size]
        starts = [0, *accumulate(size for _, size in parts)]
        whole = path_of(folder, "whole")
        if not full.startswith("file:"):
            _concatenate(spark, system, folder, [name for name, _ in parts], whole)
        else:
            local = folder.removeprefix("file://")
            with open(f"{local}/whole", "wb") as file:
                file.truncate(starts[-1])
            if parts:
                rows = [(f"{local}/{name}", start) for (name, _), start in zip(parts, starts)]
                placed = spark.createDataFrame(rows, "path string, start bigint").repartition(len(rows))
                placed.mapInArrow(_copy_parts(f"{local}/whole"), placed.schema).write.format("noop").mode("overwrite").save()
            os.truncate(f"{local}/whole", max(0, starts[-1] - 1))  # the newline after the last item
        _replace(spark, whole, path_of(full))
    finally:
        system.delete(path_of(folder), True)


def _concatenate(spark: SparkSession, system, folder: str, names: Sequence[str], whole) -> None:
    """Joins part files by the file system's own means, without the newline after the last one."""
    gateway, path_of = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not names:
        system.create(whole).close()
        return
    paths = [path_of(f"{folder}/{name}") for name in names]
    others = gateway.new_array(path_of, len(paths) - 1)
    for at, path in enumerate(paths[1:]):
        others[at] = path
    if len(others):
        system.concat(paths[0], others)
    system.truncate(paths[0], system.getFileStatus(paths[0]).getLen() - 1)
    system.rename(paths[0], whole)


def _replace(spark: SparkSession, source, target) -> None:
    """Moves a file over another one in one step."""
    gateway, fs = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    option = getattr(fs, "Options$Rename")
    options = gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, target, options)


def history_path(template: str, time: str) -> str:
    return (template or HISTORY_TEMPLATE).replace("{time}", time)


def save_history(messages: DataFrame, root: str, time: str, template: str = HISTORY_TEMPLATE) -> str:
    """Chat messages ``(conv_id, turn, role, text)`` as JSON lines in order; returns the folder written."""
    target = posixpath.join(root, history_path(template, time))
    ordered = messages.orderBy("conv_id", "turn")
    ordered.select("conv_id", "role", F.col("text").alias("content")).write.mode("overwrite").json(target)
    return target
