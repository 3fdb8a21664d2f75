"""Exact ROC curves and areas without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.operators.prefix import running_sums
from veriset.session import materialise


def class_scores(scored: DataFrame) -> DataFrame:
    """(class_index, score, is_true): every class probability of every record."""
    return scored.select("target", F.posexplode("probs").alias("class_index", "score")).select(
        "class_index", "score", (F.col("target") == F.col("class_index")).alias("is_true")
    )


def pooled_scores(scored: DataFrame) -> DataFrame:
    """All (record, class) decisions as one binary problem."""
    return class_scores(scored).select(F.lit(-1).alias("class_index"), "score", "is_true")


def score_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score of a class."""
    return scores.groupBy("class_index", "score").agg(
        F.count_if("is_true").alias("pos"), F.count_if(~F.col("is_true")).alias("neg")
    )


def auc_by_class(scored: DataFrame, labels: int) -> DataFrame:
    """One-vs-rest AUC per class from mid-ranks; null when a class has no positives or no negatives."""
    counts = score_counts(class_scores(scored))
    ranked = running_sums(counts, ["class_index"], ["score"], {"neg_below": F.col("neg")})
    sums = ranked.groupBy("class_index").agg(
        F.sum("pos").alias("support"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("wins"),
    )
    full = scored.sparkSession.range(labels).select(F.col("id").cast("int").alias("class_index"))
    return full.join(sums, "class_index", "left").select(
        "class_index",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.when(
            (F.col("support") > 0) & (F.col("negatives") > 0), F.col("wins") / (F.col("support") * F.col("negatives"))
        ).alias("auc"),
    )


def auc_averages(by_class: DataFrame) -> DataFrame:
    """Macro and prevalence-weighted AUC; null as soon as one class has none."""
    defined = F.count("auc") == F.count("*")
    return by_class.agg(
        F.when(defined, F.avg("auc")).alias("macro_auc"),
        F.when(defined, F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("weighted_auc"),
    )


def roc_points(counts: DataFrame) -> DataFrame:
    """Corner points of each class's ROC curve, the origin included, in the order ``seq`` of the thresholds.

    A threshold in the middle of a straight run (same positives and negatives as the next one) adds no
    corner and is left out, as usual for ROC curves; the first and the last threshold always stay.
    Classes without positives or negatives have no curve.
    """
    keys = ["class_index"]
    counts = materialise(counts)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    high_first = counts.withColumn("_down", -F.col("score"))
    swept = running_sums(
        high_first,
        keys,
        ["_down"],
        {"tp_before": F.col("pos"), "fp_before": F.col("neg"), "position": F.lit(1).cast("bigint")},
        following={"next_pos": F.col("pos"), "next_neg": F.col("neg")},
    )
    straight = (
        (F.col("position") > 0)
        & F.col("next_pos").eqNullSafe(F.col("pos"))
        & F.col("next_neg").eqNullSafe(F.col("neg"))
    )
    corners = (
        swept.filter(~straight)
        .join(totals, keys)
        .filter((F.col("P") > 0) & (F.col("N") > 0))
        .select(
            *keys,
            (F.col("position") + 1).alias("seq"),
            "score",
            ((F.col("fp_before") + F.col("neg")) / F.col("N")).alias("fpr"),
            ((F.col("tp_before") + F.col("pos")) / F.col("P")).alias("tpr"),
        )
    )
    origins = totals.filter((F.col("P") > 0) & (F.col("N") > 0)).select(
        *keys, F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origins.unionByName(corners)


def curve_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area under each curve."""
    steps = running_sums(
        points, ["class_index"], ["seq"], {}, following={"next_fpr": F.col("fpr"), "next_tpr": F.col("tpr")}
    )
    area = (F.col("next_fpr") - F.col("fpr")) * (F.col("next_tpr") + F.col("tpr")) / 2.0
    return steps.groupBy("class_index").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def macro_curve(points: DataFrame, labels: int) -> DataFrame:
    """(fpr, tpr) of the class-averaged curve on the union of all classes' false-positive rates.

    Between two of its own corners a class's curve is a straight line, so the average only changes
    its slope and level where some class has a corner. Those changes are summed per rate and
    accumulated along the axis: the work is linear in the corners, where interpolating every class at
    every rate would be their product. At a vertical step the upper end counts.
    """
    ends = points.groupBy("class_index", "fpr").agg(F.max("tpr").alias("top"), F.min("tpr").alias("bottom"))
    lines = running_sums(
        materialise(ends),
        ["class_index"],
        ["fpr"],
        {},
        following={"next_fpr": F.col("fpr"), "next_bottom": F.col("bottom"), "next_top": F.col("top")},
    )
    rise = F.coalesce((F.col("next_bottom") - F.col("top")) / (F.col("next_fpr") - F.col("fpr")), F.lit(0.0))
    segments = lines.select("class_index", "fpr", "next_fpr", rise.alias("slope"), (F.col("top") - rise * F.col("fpr")).alias("level"))
    # a segment starts to count at its own corner and stops at the next one
    changes = segments.select(
        F.explode(
            F.array(
                F.struct(F.col("fpr").alias("at"), F.col("slope").alias("slope"), F.col("level").alias("level")),
                F.struct(F.col("next_fpr").alias("at"), (-F.col("slope")).alias("slope"), (-F.col("level")).alias("level")),
            )
        ).alias("c")
    ).filter(F.col("c.at").isNotNull())
    by_rate = changes.groupBy(F.col("c.at").alias("fpr")).agg(F.sum("c.slope").alias("_slope"), F.sum("c.level").alias("_level"))
    swept = running_sums(by_rate, [], ["fpr"], {"slope_before": F.col("_slope"), "level_before": F.col("_level")})
    slope, level = F.col("slope_before") + F.col("_slope"), F.col("level_before") + F.col("_level")
    return swept.select("fpr", ((level + slope * F.col("fpr")) / F.lit(float(labels))).alias("tpr"))


def macro_curve_auc(curve: DataFrame) -> DataFrame:
    ordered = curve.select(F.lit(-1).alias("class_index"), F.col("fpr").alias("seq"), "fpr", "tpr")
    return curve_auc(ordered).select("auc")
