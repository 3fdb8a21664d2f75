"""The leakage audit and the leakage-safe manifest as declarative plans over a record table.

``records`` carries id, class, split, digest, object (null when unmapped) and fp.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions.names import group_key
from veriset.operators import checks, cleanup, components, links, profile, splits
from veriset.session import materialise


@dataclass(frozen=True)
class AuditTables:
    exact_groups: DataFrame
    exact_members: DataFrame
    exact_pairs: DataFrame
    near_pairs: DataFrame
    near_members: DataFrame
    object_groups: DataFrame
    object_members: DataFrame
    coverage: DataFrame
    checks: DataFrame
    status: DataFrame


def listed_manifest(lists: dict[str, DataFrame], index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve the split lists (``line``) against the index of local files (``class_name``, ``file_key``, ``path``).

    Returns the resolved rows, one per listed line with ``local_match_count``, and the contract: index keys
    do not repeat, every line has exactly one match, and no file is listed twice or in two splits.
    """
    parsed = [cleanup.parsed_list(df).withColumn("split", F.lit(name)) for name, df in lists.items()]
    keys = ["class_name", "file_key"]
    resolved = materialise(cleanup.resolve_once(reduce(DataFrame.unionByName, parsed), index, keys, ["path"]))
    contract = checks.all_checks(
        [
            checks.check("index_keys_are_unique", profile.repeated_keys(index, *keys)),
            checks.check("every_line_matches_once", cleanup.unmatched(resolved)),
            checks.check("no_file_listed_twice", profile.repeated_keys(cleanup.matched(resolved), "path")),
        ]
    )
    return resolved, contract


def leakage_audit(records: DataFrame, threshold: int = 4) -> AuditTables:
    """Exact, near and same-object leakage across splits, with the hard checks."""
    node_pairs = materialise(links.near_node_pairs(records, threshold))
    exact = links.exact_pairs(records)
    groups = links.cross_split_groups(records, "digest")
    objects = links.cross_split_groups(records, "object")
    coverage = profile.coverage(records)
    found = checks.all_checks(
        [
            checks.check("exact_duplicates", exact),
            checks.check("same_object", objects),
            checks.check("near_duplicates", node_pairs),
        ]
    )
    return AuditTables(
        exact_groups=groups,
        exact_members=links.group_members(records, groups, "digest"),
        exact_pairs=exact,
        near_pairs=node_pairs,
        near_members=links.linked_ids(records, node_pairs),
        object_groups=objects,
        object_members=links.group_members(records, objects, "object"),
        coverage=coverage,
        checks=found,
        status=checks.leakage_status(found, coverage),
    )


def leakage_safe_manifest(records: DataFrame, validation_fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clean training records against the locked test, carve a group-aware validation part out of them.

    Returns the manifest (train, validation and the untouched test) and the exclusion log. ``records`` has no validation
    part yet; one that is there fails the call, since it would have to be merged or dropped.
    """
    checks.enforce(checks.check("only_train_and_test", records.filter(~F.col("split").isin("train", "test") | F.col("split").isNull())))
    kept, log = cleanup.clean_against_test(records)
    grouped = materialise(kept.withColumn("group", group_key(F.col("object"), F.col("digest"))))
    assignment = splits.validation_prefix(splits.group_sizes(grouped), validation_fraction, seed=seed)
    manifest = splits.apply_group_split(grouped, assignment).unionByName(
        records.filter(F.col("split") == "test").withColumn("group", group_key(F.col("object"), F.col("digest")))
    )
    return manifest, log


def quarantined_manifest(records: DataFrame, threshold: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the less protected side of every strict near pair.

    Returns the manifest, the log with one row per pair of nodes, and the contract checks of the result.
    """
    node_pairs = materialise(links.near_node_pairs(records, threshold))
    nodes = materialise(cleanup.quarantined_nodes(node_pairs))
    cleaned = cleanup.after_quarantine(records, nodes)
    test = F.col("split") == "test"
    contract = checks.all_checks(
        [
            checks.check("locked_test_unchanged", checks.difference(records.filter(test), cleaned.filter(test), ["id"])),
            checks.check("no_strict_pair_survives", cleanup.surviving_node_pairs(cleaned, node_pairs)),
            checks.check("class_in_every_split", profile.missing_class_splits(cleaned)),
        ]
    )
    return cleaned, cleanup.quarantine_log(node_pairs), contract


def component_assignment(records: DataFrame, threshold: int = 4, ratios: dict[str, str] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Whole connected components, class by class, close to the wanted ratios, and the contract that holds for a clean corpus.

    A component of several classes breaks the contract; its records of each class are dealt as one group of that class. A
    class of fewer than three groups fills the first parts only.
    """
    members = materialise(components.record_components(records, threshold).withColumn("group", F.col("component").cast("string")))
    sizes = materialise(splits.group_sizes(members))
    contract = checks.all_checks(
        [
            checks.check("component_has_one_class", components.mixed_components(components.component_table(members))),
            checks.check("three_groups_per_class", splits.too_few_groups(sizes, 3)),
        ]
    )
    return splits.apply_group_split(members, splits.greedy_split(sizes, ratios, seed=seed)), contract


def component_split(records: DataFrame, threshold: int = 4, ratios: dict[str, str] | None = None, seed: int = 42) -> DataFrame:
    """``component_assignment`` of a corpus that keeps its contract; any other one fails the call."""
    placed, contract = component_assignment(records, threshold, ratios, seed)
    checks.enforce(contract)
    return placed
