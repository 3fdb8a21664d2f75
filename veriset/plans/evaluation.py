"""Every evaluation table of a scored model from one probability table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.operators import confusion, ranking, resampling, scores
from veriset.session import materialise


@dataclass(frozen=True)
class EvaluationTables:
    predictions: DataFrame
    cells: DataFrame
    class_report: DataFrame
    summary: DataFrame
    top_confusions: DataFrame
    calibration: DataFrame
    auc: DataFrame
    intervals: DataFrame


def summary_row(scored: DataFrame, labels: int, policy: str = "all", top: int = 3, bins: int = 15) -> DataFrame:
    """One row: accuracy, averaged precision/recall/F1, AUC, top-k, calibration error, log loss, Brier."""
    predicted = scores.predictions(scored)
    report = confusion.class_report(confusion.cells(predicted), labels)
    quality = confusion.averages(report, policy=policy)
    losses = confusion.probability_summary(scored, top=top).drop("records")
    auc = ranking.auc_averages(ranking.auc_by_class(scored, labels))
    ece = confusion.expected_calibration_error(confusion.calibration_bins(predicted, bins))
    row = quality
    for part in (losses, auc, ece):
        packed = part.agg(F.first(F.struct(*part.columns)).alias("p"))
        row = row.select("*", packed.scalar().alias("_p")).select(*row.columns, "_p.*")
    return row


def evaluate(scored: DataFrame, labels: int, policy: str = "all", bins: int = 15, samples: int = 1000) -> EvaluationTables:
    scored = materialise(scored)
    predicted = scores.predictions(scored)
    cells = materialise(confusion.cells(predicted))
    report = confusion.class_report(cells, labels)
    auc = ranking.auc_by_class(scored, labels)
    replicates = resampling.multinomial_replicates(cells.withColumn("model", F.lit("model")), labels, samples)
    return EvaluationTables(
        predictions=predicted,
        cells=cells,
        class_report=report.join(auc.select("class_index", "auc"), "class_index"),
        summary=summary_row(scored, labels, policy, bins=bins),
        top_confusions=confusion.top_confusions(cells),
        calibration=confusion.calibration_bins(predicted, bins),
        auc=auc,
        intervals=resampling.intervals(replicates, ["model"]),
    )
