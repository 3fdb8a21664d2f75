"""Declarative data contracts: every check is a row with its number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veriset.operators import profile

SPLITS = profile.SPLITS


class ContractError(ValueError):
    """A contract that must hold before a job may run does not."""


def check(name: str, violations: DataFrame, allowed: int = 0) -> DataFrame:
    """(check, violations, passed) for a table of violating rows."""
    return violations.agg(F.count("*").alias("violations")).select(
        F.lit(name).alias("check"), "violations", (F.col("violations") <= allowed).alias("passed")
    )


def check_count(name: str, rows: DataFrame, expected: int) -> DataFrame:
    """Cardinality contract; the violation is the distance from the expected count."""
    return rows.agg(F.abs(F.count("*") - expected).alias("violations")).select(
        F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")
    )


def all_checks(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def enforce(checks: DataFrame) -> None:
    """Raise when a check failed. The table has one row per check, so the driver reads only those."""
    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise ContractError("; ".join(f"{r.check}: {r.violations} violations" for r in failed))


def observed(df: DataFrame, contracts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counts of the rows that break each contract, taken while it is written or collected: no scan of their own."""
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(broken).alias(name) for name, broken in contracts.items()]), observation


def observed_checks(df: DataFrame, observation: Observation) -> DataFrame:
    """The checks of an observed table whose action has ended, one row per contract."""
    counts = {name: n for name, n in observation.get.items() if name != "rows"}
    rows = [(name, int(n), n == 0) for name, n in counts.items()]
    return df.sparkSession.createDataFrame(rows, "check string, violations bigint, passed boolean")


def require_columns(df: DataFrame, required: set[str], what: str = "table") -> DataFrame:
    missing = sorted(required - set(df.columns))
    if missing:
        raise ContractError(f"The {what} lacks columns: {', '.join(missing)}")
    return df


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys that both sides hold."""
    return a.select(key).filter(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_semi")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, repeated rows counted."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def mapping_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(class_index, class_name) entries that only one of two class mappings has."""
    left = a.select("class_index", "class_name", F.lit(True).alias("in_a")).distinct()
    right = b.select("class_index", "class_name", F.lit(True).alias("in_b")).distinct()
    return left.join(right, ["class_index", "class_name"], "full").filter(F.col("in_a").isNull() | F.col("in_b").isNull())


def unexpected_splits(records: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Split names that are not expected, and expected names without a record."""
    counted = records.groupBy("split").agg(F.count("*").alias("records"))
    names = records.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return counted.join(names.withColumn("known", F.lit(True)), "split", "full").filter(
        F.col("known").isNull() | F.col("records").isNull()
    )


def summary_mismatches(records: DataFrame, summary: DataFrame) -> DataFrame:
    """Splits whose record count differs from a summary table (``split``, ``records``)."""
    actual = records.groupBy("split").agg(F.count("*").alias("actual"))
    return summary.join(actual, "split", "full").filter(~F.col("records").eqNullSafe(F.col("actual")))


def nonzero_fields(summary: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of a one-row summary that should be zero and are not (or are missing)."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields])
    return summary.select(F.explode(listed).alias("f")).select("f.*").filter(~F.col("value").eqNullSafe(F.lit(0)))


def leakage_status(checks: DataFrame, coverage: DataFrame, full_coverage: float = 0.95) -> DataFrame:
    """PASS, WARN or FAIL per kind of leakage; near duplicates and thin metadata only warn."""
    found = F.when(F.col("check") == "near_duplicates", "WARN").otherwise("FAIL")
    rows = checks.select("check", F.when(F.col("violations") == 0, "PASS").otherwise(found).alias("status"))
    thin = F.when(F.col("coverage") < full_coverage, "WARN").otherwise("PASS").alias("status")
    return rows.unionByName(coverage.select(F.lit("object_coverage").alias("check"), thin))


def index_gaps(classes: DataFrame) -> DataFrame:
    """Class indices that are not exactly 0..n-1."""
    n = classes.agg(F.count_distinct("class_index").alias("n"))
    return (
        classes.select("class_index").distinct().select("*", n.scalar().alias("_n"))
        .filter((F.col("class_index") < 0) | (F.col("class_index") >= F.col("_n")))
    )


def split_integrity(records: DataFrame, keys: list[str]) -> DataFrame:
    """No key of the given kinds may lie in two splits, and every class must be in every split."""
    rows = [check(f"{k}_in_one_split", profile.keys_in_several_splits(records, k)) for k in keys]
    rows.append(check("class_in_every_split", profile.missing_class_splits(records)))
    rows.append(check("split_names", unexpected_splits(records)))
    return all_checks(rows)


def unpaired(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ids that only one of predictions and manifest has, or that repeat."""
    counts = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    both = counts(predictions, "n_predictions").join(counts(manifest, "n_manifest"), "id", "full")
    return both.filter(~(F.col("n_predictions").eqNullSafe(F.lit(1)) & F.col("n_manifest").eqNullSafe(F.lit(1))))


def run_metadata_violations(runs: DataFrame, protocol: str, test_examples: int) -> DataFrame:
    """Runs recorded under another protocol or name, on another test set, or that saw test data."""
    ok = (
        F.col("run_name").eqNullSafe(F.col("config_run_name"))
        & F.col("protocol").eqNullSafe(F.lit(protocol))
        & F.col("test_used_during_training").eqNullSafe(F.lit(False))
        & F.col("test_examples").eqNullSafe(F.lit(test_examples))
    )
    return runs.filter(~ok)
