"""Scans of labelled file trees, lists, manifests, run documents and metadata maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriset.functions.names import IMAGE_EXTENSIONS, file_extension, strip_whitespace
from veriset.operators.prefix import rank_rows
from veriset.sources.jsonobject import RANGE, json_object

MANIFEST_SCHEMA = (
    "split string, official_split string, relative_path string, source_partition string, "
    "class_index int, class_name string, official_path string, leaf_id string, sha256 string"
)
PAIR_SCHEMA = (
    "hamming_distance int, strict_threshold_match boolean, split_pair string, class_name string, path_a string, "
    "path_b string, leaf_id_a string, leaf_id_b string, involves_unmapped_leaf boolean"
)
HISTORY_SCHEMA = (
    "epoch int, learning_rate double, train_loss double, train_accuracy double, train_macro_f1 double, "
    "train_eval_loss double, train_eval_accuracy double, train_eval_macro_f1 double, validation_loss double, "
    "validation_accuracy double, validation_macro_f1 double, elapsed_seconds double, peak_gpu_memory_mb double"
)
CONFIG_SCHEMA = (
    "run_name string, model_name string, batch_size int, epochs int, total_parameters bigint, "
    "trainable_parameters bigint, dropout_rate double, seed int, data_protocol string, evaluation_protocol string"
)
SUMMARY_SCHEMA = (
    "run_name string, checkpoint_epoch int, test_examples bigint, errors bigint, test_errors bigint, "
    "test_loss double, test_accuracy double, test_macro_precision double, test_macro_recall double, "
    "test_macro_f1 double, test_weighted_f1 double, test_top3_accuracy double, test_macro_roc_auc_ovr double, "
    "data_protocol string, evaluation_protocol string, test_used_during_training boolean"
)


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``. A listing that does not select ``content`` never opens the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)


def with_path_parts(files: DataFrame, partitions: tuple[str, ...]) -> DataFrame:
    """Take (partition, class, file) from the end of each path, which may use either separator."""
    normal = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    parts = F.split(normal, "/")
    located = files.withColumn("_p", parts).withColumn("partition", F.try_element_at("_p", F.lit(-3)))
    return (
        located.filter(F.col("partition").isin(*partitions))
        .withColumn("class_name", F.element_at("_p", -2))
        .withColumn("relative_path", F.array_join(F.slice("_p", -3, 3), "/"))
        .drop("_p")
    )


def class_dimension(records: DataFrame) -> DataFrame:
    """(class_name, class_index): position of each name in sorted order."""
    ranked = rank_rows(records.select("class_name").filter(F.col("class_name").isNotNull()).distinct(), [], ["class_name"], "_rank")
    return ranked.select("class_name", (F.col("_rank") - 1).cast("int").alias("class_index"))


def labelled_tree(spark: SparkSession, root: str, partitions: tuple[str, ...] = ("train", "val"), extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Folder-labelled scan: ``root/partition/class/file`` with the class index of an image folder."""
    files = binary_files(spark, root).filter(file_extension(F.col("path")).isin(*extensions))
    located = with_path_parts(files, partitions)
    classes = class_dimension(located.select("class_name"))
    return located.join(classes, "class_name").select(
        "partition", "path", "relative_path", "class_name", "class_index", "length", "content"
    )


def selected_folders(spark: SparkSession, root: str, folders: list[str], extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files with an accepted extension in the named folders (compared without percent-encoding)."""
    files = binary_files(spark, root).withColumn("folder", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -2), F.lit("+"), F.lit("%2B"))))
    return files.filter(F.col("folder").isin(*folders) & file_extension(F.col("path")).isin(*extensions))


def manifest_csv(spark: SparkSession, path: str | list[str], schema: str | StructType = MANIFEST_SCHEMA) -> DataFrame:
    """CSV with a header. Empty fields become null, the text ``NA`` stays, paths use ``/``."""
    table = spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)
    path_columns = [f.name for f in table.schema if "path" in f.name and f.dataType.simpleString() == "string"]
    return table.withColumns({c: F.replace(F.col(c), F.lit("\\"), F.lit("/")) for c in path_columns})


def named_csv(spark: SparkSession, paths: str | list[str], schema: str = HISTORY_SCHEMA, suffix: str = "_history.csv") -> DataFrame:
    """Many CSV files at once, each row with the run name taken from its file name."""
    table = spark.read.schema(schema).option("enforceSchema", "false").csv(paths, header=True)
    file_name = F.col("_metadata.file_name")
    return table.select("*", F.left(file_name, F.length(file_name) - len(suffix)).alias("run_name"))


def json_documents(spark: SparkSession, paths: str | list[str], schema: str = SUMMARY_SCHEMA) -> DataFrame:
    """One JSON object per file, all runs in one scan."""
    return spark.read.schema(schema).json(paths, multiLine=True).select("*", F.col("_metadata.file_path").alias("source_file"))


def split_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stripped, non-blank lines."""
    return spark.read.text(path).select(strip_whitespace(F.col("value")).alias("line")).filter(F.col("line") != "")


def metadata_map(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(identifier, suggestions) from a JSON object whose values are a string or a list of strings, read in ranges of bytes."""
    entries = json_object(spark, path, size)
    listed = F.from_json(F.col("value"), "array<string>")
    suggestions = F.when(F.col("value").startswith("["), listed).when(
        F.col("value").isNotNull() & (F.col("value") != ""), F.array("value")
    )
    return entries.select("identifier", suggestions.alias("suggestions"))


def metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same map as JSON lines (``identifier``, ``suggestions``), which many tasks read."""
    return spark.read.schema("identifier string, suggestions array<string>").json(path)


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows without a file; both sides carry ``relative_path``."""
    return manifest.join(listing.select("relative_path").distinct(), "relative_path", "left_anti")
