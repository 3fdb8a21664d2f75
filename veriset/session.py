"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "veriset", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster spark-submit supplies the settings."""
    builder = (
        SparkSession.builder.appName(app_name)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="veriset-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it is deleted when the application ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/veriset/{spark.sparkContext.applicationId}"
    files, where = _hadoop(spark, path)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def clear_intermediates(spark: SparkSession) -> None:
    """Delete the tables written so far; results that still read them must have been written or collected."""
    files, where = _hadoop(spark, f"{checkpoint_root(spark).rstrip('/')}/veriset/{spark.sparkContext.applicationId}")
    files.delete(where, True)


_scope = ""


def open_scope(spark: SparkSession) -> str:
    """Gather the tables written from here on in a folder of their own, until another scope opens; returns its name."""
    global _scope
    own_folder(spark)
    _scope = f"scope-{uuid.uuid4().hex}/"
    return _scope


def drop_scope(spark: SparkSession, scope: str) -> None:
    """Delete the tables of a scope, when everything that reads them has been written."""
    files, where = _hadoop(spark, f"{own_folder(spark)}/{scope}")
    files.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table.

    The table is columnar, so later branches read only the columns they need, and it outlives lost
    executors. Used where a result feeds several branches or the next round of an iteration.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{_scope}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


#: Whether Spark deletes the shuffle files of a query when it ends; without it they stay until the driver collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_freed(df: DataFrame) -> DataFrame:
    """``materialise``, and the shuffle files of it are deleted: for iterations whose rounds shuffle much."""
    spark = df.sparkSession
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        return materialise(df)
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            files, where = _hadoop(table.sparkSession, path)
            files.delete(where, True)
