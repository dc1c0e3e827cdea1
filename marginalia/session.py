"""Session defaults and the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC times, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local test) gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="marginalia-")
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers show it: with its scheme and host, absolute, without dots."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(named).toString()


def is_folder(spark: SparkSession, path: str) -> bool:
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(named).isDirectory()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_folder(spark)}/marginalia/{purpose}-{uuid.uuid4().hex}"


def materialize(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the shared folder and read them back, so that later passes do not recompute them.

    The copy is deleted when the driver ends, as what reads it may be evaluated any time before.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, purpose)
    rows.write.parquet(folder)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(named)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
