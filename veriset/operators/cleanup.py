"""Lookups that resolve records, and removals that protect a locked split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions.names import listed_class, listed_file
from veriset.operators.checks import check, enforce
from veriset.session import materialise

# Fixed values of the removal reports. Priority: the side with the lower number goes. The locked test split is never touched.
SPLIT_PRIORITY = {"train": 0, "validation": 1, "test": 2}


# --- resolving -----------------------------------------------------------------------------


def parsed_list(lines: DataFrame, column: str = "line") -> DataFrame:
    """(line, class_name, file_key) of listed paths; both are null where a path has one segment only."""
    return lines.select(
        F.col(column).alias("line"),
        listed_class(F.col(column)).alias("class_name"),
        F.lower(listed_file(F.col(column))).alias("file_key"),
    )


def resolve_once(listed: DataFrame, index: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Look every listed row up in an index; ``local_match_count`` tells 0, 1 or more matches.

    The index is folded to one row per key first, so a repeated key cannot multiply rows.
    """
    folded = index.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(F.struct(*payload)).alias("_payload")
    )
    joined = listed.join(folded, keys, "left").withColumn("local_match_count", F.coalesce("_n", F.lit(0)))
    once = F.col("local_match_count") == 1
    return joined.select(
        *listed.columns,
        "local_match_count",
        *[F.when(once, F.col(f"_payload.{c}")).alias(c) for c in payload],
    )


def matched(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("local_match_count") == 1)


def unmatched(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("local_match_count") != 1)


def resolve_objects(records: DataFrame, object_map: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Add ``object``: the only suggestion of the identifier, else the first that contains the class."""
    suggestions = F.col("suggestions")
    fitting = F.get(F.filter(suggestions, lambda s: F.contains(s, F.col("class"))), F.lit(0))
    chosen = (
        F.when(F.size(suggestions) == 1, F.element_at(suggestions, 1)).when(F.size(suggestions) > 1, fitting)
    )
    return records.join(object_map, identifier, "left").withColumn("object", chosen).drop("suggestions")


# --- removing ------------------------------------------------------------------------------


def collisions(train: DataFrame, locked: DataFrame, key: str) -> DataFrame:
    """Training records whose key also occurs in the locked set. Null keys never collide."""
    return train.join(locked.select(key).distinct(), key, "left_semi")


def without_collisions(train: DataFrame, locked: DataFrame, key: str) -> DataFrame:
    return train.join(locked.select(key).distinct(), key, "left_anti")


def exclusion_log(removed: DataFrame, reason: str) -> DataFrame:
    return removed.select("id", "class", "split", F.lit(reason).alias("reason"))


def clean_against_test(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove training records that share a digest or an object with the test split.

    Returns the kept training records and the log; the object check runs on what the digest check kept.
    """
    train = records.filter(F.col("split") == "train")
    test = records.filter(F.col("split") == "test")
    by_digest = without_collisions(train, test, "digest")
    kept = without_collisions(by_digest, test, "object")
    log = exclusion_log(collisions(train, test, "digest"), "exact_digest_overlap_with_test").unionByName(
        exclusion_log(collisions(by_digest, test, "object"), "object_overlap_with_test")
    )
    return kept, log


def _priority(split):
    value = F.lit(None).cast("int")
    for name, rank in SPLIT_PRIORITY.items():
        value = F.when(split == name, F.lit(rank)).otherwise(value)
    return value


def _sided(pairs: DataFrame, columns: list[str]) -> list:
    """removed_x / protected_x for every pair column x_a / x_b."""
    remove_a = _priority(F.col("split_a")) < _priority(F.col("split_b"))
    picks = []
    for c in columns:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        picks.append(F.when(remove_a, a).otherwise(b).alias(f"removed_{c}"))
        picks.append(F.when(remove_a, b).otherwise(a).alias(f"protected_{c}"))
    return picks


# Fixed value of the removal reports.
QUARANTINE_REASON = "strict_cross_split_dhash_quarantine"


def quarantine_log(node_pairs: DataFrame, reason: str = QUARANTINE_REASON) -> DataFrame:
    """One row per strict pair of nodes: which side goes, which split it protects, and how many record pairs that is.

    The removed records are those of ``quarantined_records`` for the same pairs.
    """
    return node_pairs.select("class", "distance", *_sided(node_pairs, ["fp", "split", "copies", "first_id"]), "pairs", F.lit(reason).alias("reason"))


def quarantined_nodes(node_pairs: DataFrame) -> DataFrame:
    """Distinct (class, fp, split) whose records have to go."""
    return node_pairs.select("class", *_sided(node_pairs, ["fp", "split"])).select(
        "class", F.col("removed_fp").alias("fp"), F.col("removed_split").alias("split")
    ).distinct()


def quarantined_records(records: DataFrame, nodes: DataFrame) -> DataFrame:
    return records.join(nodes, ["class", "fp", "split"], "left_semi")


def after_quarantine(records: DataFrame, nodes: DataFrame) -> DataFrame:
    return records.join(nodes, ["class", "fp", "split"], "left_anti")


def surviving_node_pairs(cleaned: DataFrame, node_pairs: DataFrame) -> DataFrame:
    """Strict pairs of which both ends are still in the manifest."""
    alive = cleaned.select("class", "fp", "split").distinct()
    for side in "ab":
        own = alive.select("class", F.col("fp").alias(f"fp_{side}"), F.col("split").alias(f"split_{side}"))
        node_pairs = node_pairs.join(own, ["class", f"fp_{side}", f"split_{side}"], "left_semi")
    return node_pairs


def located_pairs(pair_paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attach both splits to an externally supplied (id_a, id_b) pair table; unknown ids give null."""
    splits = manifest.select("id", "split")
    for side in "ab":
        own = splits.select(F.col("id").alias(f"id_{side}"), F.col("split").alias(f"split_{side}"))
        pair_paths = pair_paths.join(own, f"id_{side}", "left")
    return pair_paths


def misplaced_pairs(located: DataFrame) -> DataFrame:
    """Pairs that name an unknown record or lie inside one split."""
    return located.filter(
        F.col("split_a").isNull() | F.col("split_b").isNull() | (F.col("split_a") == F.col("split_b"))
    )


def quarantine_listed(pair_paths: DataFrame, manifest: DataFrame, reason: str = QUARANTINE_REASON) -> tuple[DataFrame, DataFrame]:
    """Log and cleaned manifest for a supplied pair table (``distance``, ``id_a``, ``id_b``).

    A pair that names an unknown record or lies inside one split fails the call.
    """
    located = materialise(located_pairs(pair_paths, manifest))
    enforce(check("pairs_cross_two_known_splits", misplaced_pairs(located)))
    log = located.select("distance", *_sided(located, ["id", "split"]), F.lit(reason).alias("reason"))
    return log, manifest.join(log.select(F.col("removed_id").alias("id")).distinct(), "id", "left_anti")


def surviving_listed(pair_paths: DataFrame, cleaned: DataFrame) -> DataFrame:
    ids = cleaned.select("id")
    for side in "ab":
        pair_paths = pair_paths.join(ids.select(F.col("id").alias(f"id_{side}")), f"id_{side}", "left_semi")
    return pair_paths


def removed_per_split(removed: DataFrame) -> DataFrame:
    return removed.groupBy("split").agg(F.count_distinct("id").alias("removed"))
