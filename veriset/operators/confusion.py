"""Metrics that follow from confusion cells, plus calibration and per-row losses.

The cells are counted once, with map-side combining; everything after that works on at most
labels x labels rows per key, however many records were scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriset.functions import vectors
from veriset.operators.checks import check, enforce


def cells(predicted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return predicted.groupBy(*(keys or []), "true_index", "predicted_index").agg(F.count("*").alias("count"))


def class_indices(labels: int) -> Column:
    return F.sequence(F.lit(0), F.lit(labels - 1))


def dense_cells(counted: DataFrame, labels: int, keys: list[str] | None = None) -> DataFrame:
    """All labels x labels cells per key, zeros included."""
    keys = keys or []
    frame = counted.select(*keys).distinct() if keys else counted.sparkSession.range(1).select()
    full = frame.select(*keys, F.explode(class_indices(labels)).alias("true_index")).select(
        "*", F.explode(class_indices(labels)).alias("predicted_index")
    )
    return full.join(counted, [*keys, "true_index", "predicted_index"], "left").na.fill(0, ["count"])


def normalised_cells(dense: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of each true class per prediction; 0 for a class without records."""
    total = F.sum("count").over(Window.partitionBy(*(keys or []), "true_index"))
    return dense.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.col("count") / total))


def confusion_matrix(counted: DataFrame, class_names: list[str]) -> DataFrame:
    """Dense matrix with one column per predicted class, for export."""
    labels = len(class_names)
    wide = (
        dense_cells(counted, labels).groupBy("true_index").pivot("predicted_index", list(range(labels))).sum("count")
    )
    name = F.element_at(F.array(*[F.lit(n) for n in class_names]), F.col("true_index") + 1)
    return wide.orderBy("true_index").select(
        name.alias("true_class"), *[F.col(str(i)).alias(n) for i, n in enumerate(class_names)]
    )


def top_confusions(counted: DataFrame, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Wrong cells, most frequent first, with their share of the true class."""
    total = F.sum("count").over(Window.partitionBy(*(keys or []), "true_index"))
    wrong = counted.withColumn("error_rate", F.col("count") / total).filter(
        (F.col("true_index") != F.col("predicted_index")) & (F.col("count") > 0)
    )
    ordered = wrong.orderBy(F.desc("count"), F.desc("error_rate"), "true_index", "predicted_index")
    return ordered if limit is None else ordered.limit(limit)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_report(counted: DataFrame, labels: int, keys: list[str] | None = None) -> DataFrame:
    """Per class: precision, recall, F1, support, predictions and errors; zero division gives 0."""
    keys = keys or []
    hit = F.when(F.col("true_index") == F.col("predicted_index"), F.col("count")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(F.col("true_index").cast("int").alias("i"), F.col("count").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("predicted_index").cast("int").alias("i"), zero.alias("support"), F.col("count").alias("predicted"), zero.alias("hits")),
    )
    sums = (
        counted.select(*keys, F.explode(parts).alias("p"))
        .groupBy(*keys, F.col("p.i").alias("class_index"))
        .agg(*[F.sum(f"p.{c}").alias(c) for c in ("support", "predicted", "hits")])
    )
    frame = counted.select(*keys).distinct() if keys else counted.sparkSession.range(1).select()
    full = frame.select(*keys, F.explode(class_indices(labels)).alias("class_index"))
    counts = full.join(sums, [*keys, "class_index"], "left").na.fill(0, ["support", "predicted", "hits"])
    return (
        counts.withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("support")))
        .withColumn("errors", F.col("support") - F.col("hits"))
        .withColumn("error_rate", F.col("errors") / F.greatest("support", F.lit(1)))
    )


def averages(report: DataFrame, keys: list[str] | None = None, policy: str = "all") -> DataFrame:
    """Accuracy with macro and support-weighted precision, recall and F1.

    ``policy`` names the classes a macro average runs over: ``all`` of them, those ``observed`` as truth
    or prediction, or those that occur as truth (``true_only``).
    """
    counted = {
        "all": F.lit(True),
        "observed": (F.col("support") > 0) | (F.col("predicted") > 0),
        "true_only": F.col("support") > 0,
    }[policy]
    support = F.sum("support")

    def macro(column: str) -> Column:
        return F.avg(F.when(counted, F.col(column))).alias(f"macro_{column}")

    def weighted(column: str) -> Column:
        return _ratio(F.sum(F.col(column) * F.col("support")), support).alias(f"weighted_{column}")

    names = ("precision", "recall", "f1")
    return report.groupBy(*(keys or [])).agg(
        support.alias("records"),
        F.sum("errors").alias("errors"),
        _ratio(F.sum("hits"), support).alias("accuracy"),
        *[macro(n) for n in names],
        *[weighted(n) for n in names],
    )


def row_losses(scored: DataFrame) -> DataFrame:
    """Per record: log loss, squared probability error, and how many classes rank before the truth."""
    return scored.select(
        "*",
        vectors.log_loss_term(vectors.true_probability(F.col("probs"), F.col("target"))).alias("log_loss"),
        vectors.brier_term(F.col("probs"), F.col("target")).alias("brier"),
        vectors.true_rank(F.col("probs"), F.col("target")).alias("true_rank"),
    )


def probability_summary(scored: DataFrame, keys: list[str] | None = None, top: int = 3) -> DataFrame:
    """Mean log loss, multiclass Brier score and top-k accuracy in one pass."""
    return row_losses(scored).groupBy(*(keys or [])).agg(
        F.count("*").alias("records"),
        F.avg("log_loss").alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg((F.col("true_rank") < top).cast("double")).alias(f"top{top}_accuracy"),
    )


def calibration_bins(predicted: DataFrame, bins: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Reliability table: every bin with its count; means and gap are null for an empty bin."""
    keys = keys or []
    filled = predicted.groupBy(*keys, vectors.bin_index(F.col("confidence"), bins).alias("bin")).agg(
        F.count("*").alias("count"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )
    edges = F.array(
        *[
            F.struct(F.lit(i).alias("bin"), F.lit(low).alias("lower"), F.lit(high).alias("upper"))
            for i, (low, high) in enumerate(zip(vectors.bin_edges(bins), vectors.bin_edges(bins)[1:]))
        ]
    )
    frame = filled.select(*keys).distinct() if keys else predicted.sparkSession.range(1).select()
    layout = frame.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")
    return layout.join(filled, [*keys, "bin"], "left").na.fill(0, ["count"]).withColumn(
        "gap", F.abs(F.col("mean_confidence") - F.col("accuracy"))
    )


def expected_calibration_error(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    weighted_gap = F.sum(F.col("count") * F.coalesce("gap", F.lit(0.0)))
    return bins.groupBy(*(keys or [])).agg(_ratio(weighted_gap, F.sum("count")).alias("ece"))


def condition_sweep(predicted: DataFrame, labels: int, baseline: str = "clean") -> DataFrame:
    """Quality per (condition, model) and the accuracy drop against the baseline in percentage points."""
    keys = ["condition", "model"]
    quality = averages(class_report(cells(predicted, keys), labels, keys), keys)
    reference = quality.filter(F.col("condition") == baseline).select("model", F.col("accuracy").alias("_clean"))
    return quality.join(reference, "model", "left").select(
        "condition", "model", "accuracy", "macro_f1", "errors",
        ((F.col("_clean") - F.col("accuracy")) * 100.0).alias("accuracy_drop_pp"),
    )


def mapped_targets(records: DataFrame, mapping: DataFrame, classes: DataFrame) -> DataFrame:
    """Records of a foreign label set with the target class their label maps to.

    A mapping to a class that does not exist fails the call.
    """
    enforce(check("mapped_classes_exist", unknown_targets(mapping, classes)))
    known = mapping.join(classes.select(F.col("class_name").alias("target_class"), F.col("class_index").alias("target")), "target_class")
    return records.join(known, "source_class")


def unknown_targets(mapping: DataFrame, classes: DataFrame) -> DataFrame:
    return mapping.join(classes.select(F.col("class_name").alias("target_class")), "target_class", "left_anti")


def mapping_coverage(mapping: DataFrame, records: DataFrame) -> DataFrame:
    found = records.groupBy("source_class").agg(F.count("*").alias("records"))
    return mapping.join(found, "source_class", "left").select(
        "source_class", "target_class", F.col("records").isNotNull().alias("present"), F.coalesce("records", F.lit(0)).alias("records")
    )


def source_report(predicted: DataFrame) -> DataFrame:
    """Per foreign class: support, accuracy and errors against the mapped target."""
    return predicted.groupBy("source_class", "target_class").agg(
        F.count("*").alias("support"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.count_if(~F.col("correct")).alias("errors"),
    )
