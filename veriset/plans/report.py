"""Consolidated control report: one long table over whatever stages have run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(section: str, table: DataFrame, metrics: list[str], subject: str | None = None) -> DataFrame:
    """(section, subject, metric, value) rows of a stage's summary."""
    series = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    name = F.col(subject).cast("string") if subject else F.lit("all")
    return table.select(F.lit(section).alias("section"), name.alias("subject"), F.explode(series).alias("m")).select(
        "section", "subject", "m.metric", "m.value"
    )


def control_report(expected_sections: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Expected sections with their rows; a section without any is ``PENDING``."""
    rows = reduce(DataFrame.unionByName, stages)
    return expected_sections.select("section").join(rows, "section", "left").withColumn(
        "status", F.when(F.col("metric").isNull(), "PENDING").otherwise("DONE")
    )
