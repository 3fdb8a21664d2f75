"""Counts of records over classes, splits, folders and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("records"))


def class_split_distribution(records: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row per class with a zero-filled count per split and the total."""
    return records.groupBy("class").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits], F.count("*").alias("total")
    )


def missing_class_splits(records: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(class, split) cells without a record."""
    wide = class_split_distribution(records, splits)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in splits])).alias("c")
    return wide.select("class", cells).filter(F.col("c.n") == 0).select("class", "c.split")


def keys_in_several_splits(records: DataFrame, key: str) -> DataFrame:
    return (
        records.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count_distinct("split").alias("splits"))
        .filter(F.col("splits") > 1)
    )


def repeated_keys(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("records")).filter(F.col("records") > 1)


def coverage(records: DataFrame, key: str = "object", removed: DataFrame | None = None) -> DataFrame:
    """Records with and without metadata; removed records can be added back to the denominator."""
    counted = records.agg(F.count("*").alias("records"), F.count(key).alias("mapped"))
    if removed is None:
        counted = counted.withColumn("removed", F.lit(0).cast("bigint"))
    else:
        counted = counted.select("*", removed.agg(F.count("*").alias("n")).scalar().alias("removed"))
    return counted.select(
        "records",
        "mapped",
        (F.col("records") - F.col("mapped")).alias("unmapped"),
        "removed",
        (F.col("mapped") / F.greatest(F.col("records") + F.col("removed"), F.lit(1))).alias("coverage"),
    )


def folder_completeness(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files per folder against the expected counts (``folder``, ``expected``)."""
    actual = files.groupBy("folder").agg(F.count("*").alias("actual"))
    return (
        expected.join(actual, "folder", "full")
        .na.fill(0, ["expected", "actual"])
        .withColumn("complete", F.col("expected") == F.col("actual"))
    )
