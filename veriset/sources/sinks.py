"""Writers of result tables, summaries and matrices."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veriset.operators import checks, confusion


REPORT_ORDER = {
    "manifest": ["split", "class", "id"],
    "near_pairs": ["distance", "class", "first_id_a", "first_id_b"],
    "review": ["involves_unmapped DESC", "embedding_cosine DESC", "correlation DESC"],
    "class_report": ["f1", "support"],
    "quarantine": ["removed_split", "removed_id", "protected_split", "protected_id"],
}


def _sort_key(term: str) -> Column:
    name, _, direction = term.partition(" ")
    return F.desc(name) if direction == "DESC" else F.asc(name)


def flat_columns(df: DataFrame, separator: str = "|") -> DataFrame:
    """Arrays joined to text, for formats without nested types."""
    return df.select(
        *[
            F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema
        ]
    )


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", order_by: list[str] | None = None) -> None:
    """CSV export, sorted only when an order is asked for; ``REPORT_ORDER`` names the usual ones."""
    ordered = df.orderBy(*map(_sort_key, order_by)) if order_by else df
    flat_columns(ordered).write.mode(mode).csv(path, header=True)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row table of scalars as JSON."""
    summary.write.mode(mode).json(path)


def write_matrix(cells: DataFrame, class_names: list[str], path: str, mode: str = "errorifexists") -> None:
    confusion.confusion_matrix(cells, class_names).write.mode(mode).csv(path, header=True)


def write_probabilities(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(model, id, target, probs), laid out by model."""
    write_table(scored.select("model", "id", "target", "probs"), path, mode, ["model"])


# --- sets of tables, published at once -----------------------------------------------------

_POINTER = "CURRENT"


def signature(spark: SparkSession, inputs: list[str], parameters: dict[str, object] | None = None) -> str:
    """Digest of a stage's inputs, by path, length and time of every file below them, and of its parameters.

    Files are listed by Spark and summed up there; none is opened. A missing input counts as empty.
    """
    seen = []
    for path in sorted(inputs):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
            mark = F.xxhash64("path", "length", "modificationTime")
            seen.append(tuple(listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)")).cast("string")).first()))
        else:
            seen.append((path, "missing"))
    return hashlib.sha256(json.dumps([seen, parameters or {}], sort_keys=True, default=str).encode()).hexdigest()


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, mark: str = "") -> None:
    """Write a set of tables to a folder of its own below ``path``, then switch one pointer file to it.

    A reader finds the whole former set until the switch and the whole new one after it, also where a write fails in between.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        write_table(table, f"{path}/{version}/{name}")
    _switch(spark, path, version, sorted(tables), mark)


def _switch(spark: SparkSession, path: str, version: str, names: list[str], mark: str) -> None:
    draft = f"{path}/{_POINTER}-{version}"
    _write_text(spark, draft, json.dumps({"version": version, "mark": mark, "tables": names}))
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(hadoop.Path(draft), hadoop.Path(f"{path}/{_POINTER}"), overwrite)


def publish_checked(spark: SparkSession, table: DataFrame, contracts: dict[str, Column], path: str, name: str = "manifest") -> DataFrame:
    """Publish a table if no row breaks a contract; the rows are counted in the pass that writes them. Returns the checks.

    A broken contract fails the call, and the former set stays.
    """
    watched, observation = checks.observed(table, contracts)
    version = uuid.uuid4().hex
    write_table(watched, f"{path}/{version}/{name}")
    found = checks.observed_checks(table, observation)
    checks.enforce(found)
    _switch(spark, path, version, [name], "")
    return found


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders of the tables of the current set, by name; empty if none was published."""
    return {name: f"{path}/{found['version']}/{name}" for found in _current(spark, path) for name in found["tables"]}


def prune(spark: SparkSession, path: str) -> None:
    """Delete all sets but the current one; for when no reader of a former one is left."""
    keep = {f["version"] for f in _current(spark, path)} | {_POINTER}
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(where):
        name = entry.getPath().getName()
        if keep != {_POINTER} and name not in keep and not name.startswith("."):
            files.delete(entry.getPath(), True)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[str] | None = None, parameters: dict[str, object] | None = None) -> DataFrame:
    """Result of a stage: read when it was built from the same inputs and parameters, built and published otherwise."""
    mark = signature(spark, inputs or [], parameters)
    if not any(found["mark"] == mark for found in _current(spark, path)):
        publish(spark, {"result": build()}, path, mark)
    return spark.read.parquet(published(spark, path)["result"])


def _current(spark: SparkSession, path: str) -> list[dict]:
    """The pointer's content, or nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    stream = files.open(where)
    try:
        return [json.loads(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode())]
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
