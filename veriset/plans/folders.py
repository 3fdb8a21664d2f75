"""From a folder of labelled images and a metadata map to the record table that the audits read, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.functions.names import object_identifier
from veriset.operators import checks, cleanup, images, review
from veriset.plans.audit import AuditTables
from veriset.session import materialise
from veriset.sources import files


def audit_records(spark: SparkSession, root: str, object_map: DataFrame, splits: dict[str, str] | None = None) -> DataFrame:
    """(id, class, split, digest, object, fp) of every image below ``root/partition/class/file``.

    ``object_map`` is (identifier, suggestions), e.g. from ``files.metadata_map`` or ``files.metadata_lines``; ``splits`` maps
    partition folders to split names. Files are read twice, once as bytes for the digest and once decoded; only digests and
    hashes are kept, in one written table.
    """
    names = splits or {"train": "train", "val": "validation", "test": "test"}
    tree = images.content_digests(files.labelled_tree(spark, root, tuple(names)))
    hashes = images.dhashes(files.image_pixels(spark, root)).select(_location(F.col("path")).alias("at"), "fp")
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    listed = tree.select(
        F.col("relative_path").alias("id"),
        F.col("class_name").alias("class"),
        named[F.col("partition")].alias("split"),
        "digest",
        object_identifier(F.element_at(F.split("relative_path", "/"), -1)).alias("identifier"),
        _location(F.col("path")).alias("at"),
    )
    hashed = listed.join(hashes, "at", "left").drop("at")
    return materialise(cleanup.resolve_objects(hashed, object_map).select("id", "class", "split", "digest", "object", "fp"))


def _location(path: Column) -> Column:
    """A path without its scheme; the two readers spell it differently."""
    return F.url_decode(F.replace(F.regexp_replace(path, r"^[a-z]+:/+", "/"), F.lit("+"), F.lit("%2B")))


def audit_summary(records: DataFrame, tables: AuditTables, near_threshold: int = 4) -> DataFrame:
    """One row: records per split, exact groups and pairs, near pairs, objects over splits, coverage, and the verdict."""
    zero = F.lit(0).cast("bigint")
    exact = tables.exact_pairs.agg(F.struct(F.count_distinct("digest").alias("groups"), F.coalesce(F.sum("pairs"), zero).alias("pairs")).alias("s")).scalar()
    near = tables.near_pairs.agg(F.coalesce(F.sum("pairs"), zero).alias("n")).scalar()
    objects = tables.object_groups.agg(F.count("*").alias("n")).scalar()
    worst = tables.status.agg(F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)).alias("n")).scalar()
    counts = records.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_records") for s in checks.SPLITS])
    cover = tables.coverage.agg(F.max(F.struct("mapped", "coverage")).alias("s")).scalar()
    return counts.select("*", exact.alias("e"), near.alias("near_pairs"), objects.alias("objects_over_splits"), cover.alias("c"), worst.alias("w")).select(
        *counts.columns,
        F.col("e.groups").alias("exact_groups"),
        F.col("e.pairs").alias("exact_pairs"),
        "near_pairs",
        F.lit(near_threshold).alias("near_threshold"),
        "objects_over_splits",
        F.col("c.mapped").alias("mapped_records"),
        F.col("c.coverage").alias("coverage"),
        F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("w") + 1).alias("status"),
    )


def manifest_summary(manifest: DataFrame, log: DataFrame) -> DataFrame:
    """One row: records per split, removals by reason, and metadata coverage of the cleaned training side and of the test."""
    test = F.col("split") == "test"
    counts = manifest.agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_records") for s in checks.SPLITS],
        (F.count_if(~test & F.col("object").isNotNull()) / F.greatest(F.count_if(~test), F.lit(1))).alias("clean_coverage"),
        (F.count_if(test & F.col("object").isNotNull()) / F.greatest(F.count_if(test), F.lit(1))).alias("test_coverage"),
    )
    gone = log.agg(F.struct(F.count_if(F.col("reason").startswith("exact")).alias("x"), F.count_if(F.col("reason").startswith("object")).alias("o")).alias("s")).scalar()
    return counts.select("*", gone.alias("_g")).select(*counts.columns, F.col("_g.x").alias("removed_exact"), F.col("_g.o").alias("removed_object"))


def quarantine_summary(records: DataFrame, cleaned: DataFrame, node_pairs: DataFrame) -> DataFrame:
    """One row: strict pairs, how many involve a record without object, and records removed per split."""
    zero = F.lit(0).cast("bigint")
    pairs = review.content_pairs(node_pairs, records.withColumn("_one", F.lit(1)), "_one")
    totals = pairs.agg(F.coalesce(F.sum("pairs"), zero).alias("strict_pairs"), F.coalesce(F.sum("unmapped_pairs"), zero).alias("unmapped_pairs"))
    before, after = (df.agg(F.struct(*[F.count_if(F.col("split") == s).alias(s) for s in checks.SPLITS]).alias("s")).scalar() for df in (records, cleaned))
    return totals.select("*", before.alias("_b"), after.alias("_a")).select(
        "strict_pairs", "unmapped_pairs", *[(F.col(f"_b.{s}") - F.col(f"_a.{s}")).alias(f"removed_{s}") for s in checks.SPLITS]
    )
