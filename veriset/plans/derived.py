"""Records, features and histories that the registered queries derive from the supplied tables.

Documents stand in for image files: the text is the content, the language the class, and a grid of
token counts takes the place of the 8 x 9 grey thumbnail that the difference hash reads.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from veriset.functions import vectors
from veriset.functions.names import hash60
from veriset.operators import scores
from veriset.session import materialise

LABELS = 10
GRID_CELLS = vectors.GRID_ROWS * vectors.GRID_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(record_id: Column) -> Column:
    bucket = hash60(F.lit("split:42:"), record_id) % 10
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")


class _TokenCells(dict):
    """Grid cell of each token seen so far, cleared when it grows large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 131_072:
            self.clear()
        cell = self[token] = int(hashlib.md5(token).hexdigest()[:15], 16) % GRID_CELLS
        return cell


@F.arrow_udf(ArrayType(IntegerType()))
def token_grid(texts: pa.Array) -> pa.Array:
    """Row-major 8 x 9 counts of whitespace tokens by their hash, like the grey grid of an image.

    Arrow batches: hashing and counting millions of tokens costs a fraction of what the same array
    expressions cost, and nothing is shuffled. Splitting bytes cuts at ASCII whitespace only. A task
    holds one text beside its batch, not a Python copy of all texts of it.
    """
    cells = _TokenCells()
    counts = np.zeros((len(texts), GRID_CELLS), np.int32)
    for row, text in zip(counts, texts, strict=True):
        found = [cells[token] for token in text.as_py().lower().encode().split()]
        row[:] = np.bincount(np.array(found, dtype=np.int64), minlength=GRID_CELLS)
    ends = np.arange(0, counts.size + 1, GRID_CELLS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.ravel()))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, class, source, split, digest, object) of every document."""
    raw = table(spark, folder, "documents")
    doc = F.col("doc_id")
    return raw.select(
        doc.alias("id"),
        F.col("lang").alias("class"),
        "source",
        split_of(doc).alias("split"),
        F.sha2("text", 256).alias("digest"),
        F.when(hash60(F.lit("leaf:"), doc) % 4 != 0, F.concat("lang", F.lit(":::"), F.expr("doc_id div 5"))).alias("object"),
        "text",
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without their text, written once: plans with several branches read every text one time."""
    return materialise(documents(spark, folder).drop("text"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their grid and hash, computed once and written: every audit branch reads this."""
    hashed = documents(spark, folder).withColumn("grid", token_grid(F.col("text"))).drop("text")
    return materialise(hashed.withColumn("fp", vectors.dhash_from_grid(F.col("grid"))))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        vec.alias("id"),
        F.col("label").alias("target"),
        split_of(vec).alias("split"),
        F.when(hash60(F.lit("leaf:"), vec) % 4 != 0, F.concat(F.col("label").cast("string"), F.lit(":::"), F.expr("vec_id div 5"))).alias("object"),
        "embedding",
    )


def model_features(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Features of model ``a`` (the whole vector) or of ``b``, the second one of an ensemble (the vector from place 33)."""
    seen = {"a": F.col("embedding"), "b": F.slice("embedding", 33, F.greatest(F.size("embedding") - 32, F.lit(0)))}[model]
    return embeddings(spark, folder).withColumn("features", seen).drop("embedding")


def scored(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Class probabilities of every embedding from centroids fitted on the training split."""
    features = model_features(spark, folder, model)
    fitted = scores.centroids(features.filter(F.col("split") == "train"))
    return scores.centroid_scores(features, fitted).select("id", "target", "split", "probs")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as run histories: the user is the run, the event its epoch."""
    def share(salt: str) -> Column:
        return (hash60(F.lit(f"{salt}:"), F.col("event_id")) % 1000) / 1000.0

    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("loss"),
        share("f1").alias("f1"),
        share("train").alias("train_accuracy"),
        share("traineval").alias("train_eval_accuracy"),
        share("val").alias("validation_accuracy"),
        share("trainevalf1").alias("train_eval_macro_f1"),
        (F.col("value") * 60.0).alias("elapsed_seconds"),
        (hash60(F.lit("mem:"), F.col("event_id")) % 4096).cast("double").alias("peak_memory_mb"),
    )


def run_config(spark: SparkSession, folder: str) -> DataFrame:
    """One configuration per customer-like run id; some runs record trainable parameters only."""
    runs = table(spark, folder, "events").select(F.col("user_id").alias("run")).distinct()
    size = hash60(F.lit("params:"), F.col("run")) % 20_000_000 + 1_000_000
    partial = hash60(F.lit("partial:"), F.col("run")) % 3 == 0
    return runs.select(
        "run",
        F.when(~partial, size).alias("total_parameters"),
        F.when(partial, size).alias("trainable_parameters"),
        (hash60(F.lit("seed:"), F.col("run")) % 3).alias("seed"),
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Test results per run; the error count sits under one of two names or is missing."""
    runs = table(spark, folder, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("test_examples"))
    kind = hash60(F.lit("kind:"), F.col("run")) % 3
    wrong = hash60(F.lit("wrong:"), F.col("run")) % F.col("test_examples")
    return runs.select(
        "run",
        "test_examples",
        F.when(kind == 0, wrong).alias("errors"),
        F.when(kind == 1, wrong).alias("test_errors"),
        (1.0 - wrong / F.col("test_examples")).alias("test_accuracy"),
        ((hash60(F.lit("testf1:"), F.col("run")) % 1000) / 1000.0).alias("test_macro_f1"),
    )
