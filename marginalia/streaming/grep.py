"""The line search over arriving documents, and saving its reports under paths of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.markdown import fence_choice
from ..operators.joins import join_keys
from ..operators.lines import grep_report
from ..operators.ordered import placed
from ..operators.sinks import output_paths
from ..session import materialize
from ..spec import LineSpec

VERSIONS_CONF = "spark.sql.streaming.maxBatchesToRetainInMemory"


def read_documents(
    spark: SparkSession, folder: str, schema: StructType, name_filter: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def stream_grep(documents: DataFrame, spec: LineSpec, path: str = "path", text: str = "text") -> DataFrame:
    """Search each arriving document; the same expression as the batch search."""
    ticks = fence_choice(F.col(path), F.col(text))
    return grep_report(documents, spec, text, ticks)


def run_to_parquet(rows: DataFrame, target: str, checkpoint: str, versions: int | None = None) -> None:
    """Process what has arrived and stop; the file sink's log keeps every row exactly once.

    ``versions`` of the state stay in the memory of executors from batch to batch, as the session says if it is not given.
    With 0 only the tasks at work hold their part of it, which is read from the checkpoint again for each batch and, as Spark
    then makes no snapshots, from the changes of all batches before: for a large state and runs of few batches.
    """
    writer = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    conf = rows.sparkSession.conf
    before = conf.get(VERSIONS_CONF)
    conf.set(VERSIONS_CONF, before if versions is None else versions)
    try:
        query = writer.start(target)  # takes a copy of the settings
    finally:
        conf.set(VERSIONS_CONF, before)
    query.awaitTermination()


def numbered_path(path: Column, nth: Column) -> Column:
    """``a/b.md`` for the first item of a path, then ``a/b (2).md`` and so on; leading dots of a name begin no suffix."""
    parts = r"\A((?s:.*/)?[^/]*[^/.][^/]*)(\.[^./]*)\z"
    found = F.regexp_extract(path, parts, 1)
    base = F.when(found == "", path).otherwise(found)
    return F.when(nth > 1, F.concat(base, F.lit(" ("), nth.cast("string"), F.lit(")"), F.regexp_extract(path, parts, 2))).otherwise(path)


def count_paths(batch: DataFrame, counts: str, batch_id: int) -> DataFrame:
    """Paths of a batch that are met again, in it or after earlier batches, and how often they were met ``before``.

    Each batch writes the counts of its own paths below ``counts``, so a batch that is replayed replaces its counts and finds
    those of the batches before it. Only paths are read and shuffled, in sums per task first.
    """
    batch.groupBy("out_path").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
    kept = batch.sparkSession.read.schema("out_path string, n bigint, batch bigint").parquet(counts)
    own = kept.filter(F.col("batch") == batch_id).drop("batch")
    earlier = kept.filter(F.col("batch") < batch_id).groupBy("out_path").agg(F.sum("n").alias("before"))
    known = join_keys(own, earlier, ["out_path"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return known.filter(F.col("n") + F.col("before") > 1).select("out_path", "before")


def settle_paths(arrived: DataFrame, again: DataFrame) -> DataFrame:
    """Items ``(out_path, content, __row)`` of a batch, those of paths met again under numbered paths.

    Places are found on paths and ids alone, dealt by ranges of both, so that a path of very many items is many tasks; the
    contents meet their numbers on the ids.
    """
    known = join_keys(arrived.select("out_path", "__row"), again, ["out_path"])
    numbers = placed(known, ["out_path"], ["__row"], "__place").select("__row", (F.col("before") + F.col("__place") + 1).alias("__nth"))
    settled = numbered_path(F.col("out_path"), F.coalesce("__nth", F.lit(1)))
    return arrived.join(numbers, "__row", "left").select(settled.alias("out_path"), "content")


def stream_save(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    template: str,
    timestamp: str,
    time: str,
    out: str = "report",
    on_repeat: str = "error",
) -> None:
    """Per-item outputs while streaming, each under a path that no earlier item has, in its batch or any before it.

    A path met again is an error that ends the stream before anything of its batch is written (``error``), or it gets a
    number (``number``); an item without a path cannot get one, so a second one is an error in both. How often each path was
    met is kept beside the stream's checkpoint, see ``count_paths``. Each batch owns a folder by its id, so a replayed batch
    replaces it; it is written as it arrives unless paths in it are met again.
    """
    if on_repeat not in ("error", "number"):
        raise ValueError(f"a repeated path is an error or gets a number, not {on_repeat!r}")

    def save(batch: DataFrame, batch_id: int) -> None:
        again = count_paths(batch, f"{checkpoint}/paths", batch_id)
        met, unnamed, first = again.agg(F.count(F.lit(1)), F.count_if(F.col("out_path").isNull()), F.min("out_path")).first()
        if unnamed or (met and on_repeat == "error"):
            raise ValueError(f"several items share an output path: {first}")
        if met:
            arrived = materialize(batch.withColumn("__row", F.monotonically_increasing_id()), "arrived")
            batch = settle_paths(arrived, again)
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    named = output_paths(rows.withColumn("content", F.col(out)), template, timestamp, time)
    query = (
        named.select("out_path", "content")
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
