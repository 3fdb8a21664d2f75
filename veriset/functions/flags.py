"""Review flags of suspicious pairs. The thresholds are fixed values of the audited protocol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_DISTANCE = 4
REVIEW_DISTANCE = 8
VERY_HIGH_COSINE = 0.9995
HIGH_COSINE = 0.995
REVIEW_COSINE = 0.990
REVIEW_CORRELATION = 0.995
REVIEW_MAE = 0.03


def strict_match(distance: Column, threshold: int = STRICT_DISTANCE) -> Column:
    return distance <= threshold


def pixel_flag(correlation: Column, mae: Column, min_correlation: float = REVIEW_CORRELATION, max_mae: float = REVIEW_MAE) -> Column:
    return (correlation >= min_correlation) & (mae <= max_mae)


def embedding_flag(cosine: Column, threshold: float = REVIEW_COSINE) -> Column:
    return cosine >= threshold


def involves_unmapped(object_a: Column, object_b: Column) -> Column:
    return object_a.isNull() | object_b.isNull()


def review_priority(unmapped: Column, pixel: Column, embedding: Column) -> Column:
    return unmapped | pixel | embedding


def fallback_protocol(data_protocol: Column, evaluation_protocol: Column) -> Column:
    """Protocol name under whichever of its two names a run recorded it."""
    return F.coalesce(data_protocol, evaluation_protocol)


def fallback_errors(errors: Column, test_errors: Column, accuracy: Column, examples: Column) -> Column:
    """Error count under whichever name a run recorded it, else derived from its accuracy."""
    derived = F.bround((1.0 - accuracy) * examples, 0).cast("bigint")
    return F.coalesce(errors, test_errors, derived)
