"""Exact and near duplicates that cross splits.

Copies are folded into *nodes*: one row per (key, split) with the number of copies and the smallest member. Pairs are
pairs of nodes, at every size: one row with the copies of both sides and the number of record pairs it stands for. The
records behind them are member tables, one row per record. So no result grows with the product of two groups, and none
leaves a record out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions.names import split_pair
from veriset.operators.nearhash import BLOCK, Totals, near_hashes, near_totals
from veriset.session import materialise


# --- group reports -------------------------------------------------------------------------


def cross_split_groups(records: DataFrame, key: str) -> DataFrame:
    """Keys whose records lie in more than one split: splits, record count and classes."""
    return (
        records.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_set("split")).alias("splits"),
            F.count("*").alias("records"),
            F.sort_array(F.collect_set("class")).alias("classes"),
        )
        .filter(F.size("splits") > 1)
    )


def group_members(records: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, split, id, class) of every record of the groups."""
    return records.select(key, "split", "id", "class").join(groups.select(key), key, "left_semi")


# --- exact pairs ---------------------------------------------------------------------------


def split_nodes(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, split): copies and the smallest id with its class."""
    return records.groupBy(*keys, "split").agg(
        F.count("*").alias("copies"),
        F.min("id").alias("first_id"),
        F.min_by("class", "id").alias("first_class"),
    )


def exact_node_pairs(records: DataFrame, key: str = "digest") -> DataFrame:
    """Pairs of splits that share a key. A key has at most one node per split, so its list is tiny."""
    filled = records.filter(F.col(key).isNotNull())
    nodes = split_nodes(filled, [key]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("split", "copies", "first_id", "first_class"))).alias("nodes")
    )
    pairs = F.flatten(
        F.transform(
            "nodes",
            lambda a: F.transform(
                F.filter("nodes", lambda b: b.split > a.split), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    return nodes.filter(F.size("nodes") > 1).select(key, F.explode(pairs).alias("p")).select(
        key,
        *[F.col(f"p.{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("split", "copies", "first_id", "first_class")],
    )


def exact_pairs(records: DataFrame, key: str = "digest") -> DataFrame:
    """Pairs of splits that share a key, the smaller split name first: copies, first members and ``pairs`` of records."""
    return exact_node_pairs(records, key).withColumn("pairs", F.col("copies_a") * F.col("copies_b"))


def exact_pair_totals(records: DataFrame, key: str = "digest") -> DataFrame:
    """Exact number of cross-split pairs per pair of splits, without listing any."""
    return (
        exact_node_pairs(records, key)
        .groupBy(split_pair(F.col("split_a"), F.col("split_b")).alias("split_pair"))
        .agg(F.sum(F.col("copies_a") * F.col("copies_b")).alias("pairs"), F.count("*").alias("groups"))
    )


def two_sided_pairs(left: DataFrame, right: DataFrame, key: str = "digest") -> DataFrame:
    """Keys that two record sets share, e.g. cleaned training records and a locked test set, with both sides' copies."""
    sides = [
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{name}_copies"), F.min("id").alias(f"{name}_first_id"))
        for df, name in ((left, "left"), (right, "right"))
    ]
    return sides[0].join(sides[1], key).withColumn("pairs", F.col("left_copies") * F.col("right_copies"))


def exact_link_count(records: DataFrame, key: str = "digest") -> DataFrame:
    """Links needed to connect all equal records: one less than the copies of each key."""
    return records.filter(F.col(key).isNotNull()).groupBy(key).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("links")
    )


# --- near pairs ----------------------------------------------------------------------------


def hash_nodes(records: DataFrame) -> DataFrame:
    """One row per (class, fp, split) of the records that have a fingerprint."""
    return records.filter(F.col("fp").isNotNull()).groupBy("class", "fp", "split").agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id")
    )


def distinct_hashes(nodes: DataFrame) -> DataFrame:
    flag = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)
    return nodes.groupBy("class", "fp").agg(F.bit_or(flag).alias("in_splits"))


def near_node_pairs(records: DataFrame, threshold: int, bands: int | None = None, size: int = BLOCK, totals: Totals | None = None) -> DataFrame:
    """Cross-split pairs of hash nodes within a class, identical hashes included (distance 0).

    The smaller split name comes first, so each unordered pair of nodes comes once. ``pairs`` counts its record pairs.
    With ``totals`` the pairs, whose number grows with the square of a class, never are rows: each pair of ``records`` is
    added up in the task that finds it, and the result has the totals, a row per task.
    """
    if totals:
        named = records.filter(F.col("fp").isNotNull() & F.col("split").isNotNull()).withColumn("in_split", F.xxhash64("split"))
        return near_totals(named, "class", threshold, "in_split", totals, bands, size)
    nodes = materialise(hash_nodes(records))
    found = near_hashes(distinct_hashes(nodes), "class", threshold, bands, size)
    same = distinct_hashes(nodes).filter(F.bit_count("in_splits") > 1).select(
        "class", F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"), F.lit(0).alias("distance")
    )
    sides = {
        side: nodes.select(
            "class",
            F.col("fp").alias(f"fp_{side}"),
            F.col("split").alias(f"split_{side}"),
            F.col("copies").alias(f"copies_{side}"),
            F.col("first_id").alias(f"first_id_{side}"),
        )
        for side in "ab"
    }
    crossing = F.when(F.col("fp_a") == F.col("fp_b"), F.col("split_a") < F.col("split_b")).otherwise(
        F.col("split_a") != F.col("split_b")
    )
    linked = (
        found.unionByName(same)
        .join(sides["a"], ["class", "fp_a"])
        .join(sides["b"], ["class", "fp_b"])
        .filter(crossing)
    )
    swap = F.col("split_a") > F.col("split_b")
    return linked.select(
        "class",
        "distance",
        *[
            F.when(swap, F.col(f"{c}_{other}")).otherwise(F.col(f"{c}_{own}")).alias(f"{c}_{own}")
            for c in ("fp", "split", "copies", "first_id")
            for own, other in (("a", "b"), ("b", "a"))
        ],
        (F.col("copies_a") * F.col("copies_b")).alias("pairs"),
    )


def linked_nodes(node_pairs: DataFrame) -> DataFrame:
    """Distinct (class, fp, split) that occur in a pair."""
    sides = [node_pairs.select("class", F.col(f"fp_{s}").alias("fp"), F.col(f"split_{s}").alias("split")) for s in "ab"]
    return sides[0].union(sides[1]).distinct()


def linked_ids(records: DataFrame, node_pairs: DataFrame) -> DataFrame:
    """(class, fp, split, id) of every record that stands behind a pair."""
    return records.select("class", "fp", "split", "id").join(linked_nodes(node_pairs), ["class", "fp", "split"], "left_semi")
