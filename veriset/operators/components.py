"""Connected components over shared objects, equal contents and near hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.operators import links
from veriset.operators.nearhash import near_count, near_forest
from veriset.operators.prefix import rank_rows
from veriset.session import materialise


def _signature(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("edges"), F.bit_xor(F.xxhash64("big", "small")).alias("mix"), F.sum(F.col("small").cast("decimal(38,0)")).cast("string").alias("total")
    ).first()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex that has an edge; the component is its smallest id.

    ``edges`` holds bigint columns ``big`` and ``small``. Alternating large-star and small-star steps
    (Kiveris et al. 2014) keep the edge count from growing, also around a vertex with very many
    neighbours: the minimum of a neighbourhood is combined before the shuffle and joined back as
    one row. Every round is written out, so a lost executor costs one round at most.
    """
    current = materialise(
        edges.filter(F.col("big") != F.col("small"))
        .select(F.greatest("big", "small").alias("big"), F.least("big", "small").alias("small"))
        .distinct()
    )
    before = _signature(current)
    for _ in range(max_rounds):
        current = materialise(_small_star(_large_star(current)))
        after = _signature(current)
        if after == before:
            return current.select(F.col("big").alias("id"), F.col("small").alias("component")).unionByName(
                current.select(F.col("small").alias("id"), F.col("small").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"Components did not settle within {max_rounds} rounds.")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("big").alias("u"), F.col("small").alias("v")), F.struct(F.col("small").alias("u"), F.col("big").alias("v")))).alias("e")).select("e.u", "e.v")
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("big").agg(F.min("small").alias("m"))
    moved = edges.join(lowest, "big").filter(F.col("small") != F.col("m")).select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.unionByName(lowest.select("big", F.col("m").alias("small"))).distinct()


def _stars(members: DataFrame, key: list[str]) -> DataFrame:
    """Edges from every distinct representative of a key to the smallest one."""
    centres = members.groupBy(*key).agg(F.min("rep").alias("small"))
    return members.join(centres, key).filter(F.col("rep") != F.col("small")).select(F.col("rep").alias("big"), "small")


def record_components(records: DataFrame, threshold: int = 4, near_edges: bool = True) -> DataFrame:
    """(id, class, split, component) over equal digests, shared objects and near hashes of one class.

    Copies are folded into their smallest id before any edge is built.
    """
    smallest = records.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"))
    # A record without a digest is no copy of another and stands for itself.
    joined = records.select("id", "class", "split", "digest", "object", "fp").join(smallest, "digest", "left")
    placed = materialise(joined.withColumn("rep", F.coalesce("rep", "id")))
    folded = placed.select("rep", "class", "object", "fp").distinct()
    edges = _stars(folded.filter(F.col("object").isNotNull()).select("rep", "object").distinct(), ["object"])
    if near_edges:
        hashed = folded.filter(F.col("fp").isNotNull()).select("rep", "class", "fp").distinct()
        centres = hashed.groupBy("class", "fp").agg(F.min("rep").alias("centre"))
        near = near_forest(centres, "class", threshold)
        edges = edges.unionByName(_stars(hashed, ["class", "fp"])).unionByName(
            near.join(centres.select("class", F.col("fp").alias("fp_a"), F.col("centre").alias("big")), ["class", "fp_a"])
            .join(centres.select("class", F.col("fp").alias("fp_b"), F.col("centre").alias("small")), ["class", "fp_b"])
            .select("big", "small")
        )
    found = connected_components(edges).withColumnRenamed("id", "rep")
    return placed.join(found, "rep", "left").select(
        "id", "class", "split", F.coalesce("component", "rep").alias("component")
    )


def component_table(members: DataFrame) -> DataFrame:
    """One row per component: size, classes and the class itself. More than one class is a violation."""
    return members.groupBy("component").agg(
        F.count("*").alias("size"),
        F.count_distinct("class").alias("classes"),
        F.min("class").alias("class"),
    )


def mixed_components(table: DataFrame) -> DataFrame:
    return table.filter(F.col("classes") > 1)


def numbered_groups(table: DataFrame, prefix: str = "strict_group_", start: int = 0) -> DataFrame:
    """Give the components consecutive names in the order of their smallest member."""
    ranked = rank_rows(table, [], ["component"], "_n")
    return ranked.withColumn("group_id", F.format_string(f"{prefix}%06d", F.col("_n") - 1 + start)).drop("_n")


def link_counts(records: DataFrame, threshold: int = 4) -> DataFrame:
    """How many links each evidence gives: n-1 per digest, and every pair within the hash threshold."""
    hashed = records.filter(F.col("fp").isNotNull()).groupBy("class", "fp").agg(F.count("*").alias("copies"))
    counts = materialise(hashed)
    across = near_count(counts, "class", threshold, "copies").select(F.col("links").alias("n"))
    within = counts.select(F.expr("copies * (copies - 1) div 2").alias("n"))
    near_total = across.unionByName(within).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"))
    exact = links.exact_link_count(records)
    return exact.select(F.lit("exact").alias("evidence"), "links").unionByName(
        near_total.select(F.lit("near").alias("evidence"), "links")
    )
