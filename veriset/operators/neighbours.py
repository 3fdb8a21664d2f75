"""Closest cross-split neighbour by embedding: exact, in bounded pieces, and without needless comparisons.

Equal vectors of a split are folded into their smallest id first. The vectors of each class and split form a ball tree, kept
as tables: a ball with too many vectors is split among a few of them, and every ball knows its centre, its radius and its
parent. Two trees are compared from the roots down, level by level as joins of balls with their children; a pair of balls
goes on only if it can hold something closer than what is certain to be found elsewhere. Then the leaves are compared, the
nearest one first, and after that only those that could still hold something closer. The bound is the triangle inequality
on angles, so nothing is missed; a class of any size takes this way.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriset.functions import flags, vectors
from veriset.functions.names import pair_key, split_pair
from veriset.session import materialise

SPLIT_PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))
BLOCK_ROWS = 2048
#: Vectors of a leaf, balls that a ball is split into, and vectors dealt by one task.
LEAF, FAN, DEALT = 4096, 16, 65_536
#: A child with a larger share of its ball is not split again: its vectors lie too close for angles to part them.
STUCK = 0.9
# arccos loses about 1.5e-8 near 1; the bound on angles is taken with a much wider margin, and ties keep the smaller id.
SLACK = 1e-6

_FOUND = ["class", "query_split", "candidate_split", "query_id", "candidate_id", "similarity"]


def _best_in_block(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Best candidate of every query within one block pair; equal similarities favour the smaller id."""
    if queries.empty or candidates.empty:
        return pd.DataFrame(columns=_FOUND)
    candidates = candidates.sort_values("id")
    target = np.stack(candidates["unit"].to_numpy()).T
    ids = candidates["id"].to_numpy()
    similarity = np.stack(queries["unit"].to_numpy()) @ target
    position = similarity.argmax(axis=1)
    best = similarity[np.arange(len(queries)), position]
    columns = [queries[c].to_numpy() for c in ("class", "query_split", "candidate_split", "id")]
    return pd.DataFrame(dict(zip(_FOUND, [*columns, ids[position], best], strict=True)))


def _compare(queries: DataFrame, candidates: DataFrame, cell: list[str], sizes: DataFrame, block_rows: int) -> DataFrame:
    """Compare queries and candidates that share a cell, in block pairs of bounded size.

    ``sizes`` is (cell, query_rows, candidate_rows). A row is repeated once per block of the other side,
    so a cell of any size is spread over many tasks and no task holds more than two blocks.
    """
    plan = sizes.select(
        *cell,
        *[F.ceil(F.col(f"{side}_rows") / block_rows).cast("int").alias(f"{side}_blocks") for side in ("query", "candidate")],
    )

    def placed(side: str, other: str, rows: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.col(f"{side}_blocks")).cast("int").alias(f"{side}_block")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        # both sides may come from one table, so each gets columns of its own
        return rows.join(plan, cell).select(*[F.col(c).alias(c) for c in (*cell, "id", "unit")], own, every)

    keys = [*cell, "query_block", "candidate_block"]
    class_type, id_type = (queries.schema[c].dataType.simpleString() for c in ("class", "id"))
    schema = (
        f"class {class_type}, query_split string, candidate_split string, "
        f"query_id {id_type}, candidate_id {id_type}, similarity double"
    )
    left, right = placed("query", "candidate", queries), placed("candidate", "query", candidates)
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_best_in_block, schema)


def _best(found: DataFrame) -> DataFrame:
    order = F.struct(-F.col("similarity"), F.col("candidate_id"))
    return (
        found.groupBy("class", "query_split", "candidate_split", "query_id")
        .agg(F.min_by(F.struct("candidate_id", "similarity"), order).alias("b"))
        .select("class", "query_split", "candidate_split", "query_id", "b.candidate_id", "b.similarity")
    )


def _query_sides(records: DataFrame) -> DataFrame:
    """Per class and pair of splits, which side queries: the one with fewer records, the first on ties."""
    counts = records.groupBy("class").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")]
    )
    sides = []
    for first, second in SPLIT_PAIRS:
        first_queries = F.col(first) <= F.col(second)
        sides.append(
            counts.filter((F.col(first) > 0) & (F.col(second) > 0)).select(
                "class",
                F.when(first_queries, F.lit(first)).otherwise(F.lit(second)).alias("query_split"),
                F.when(first_queries, F.lit(second)).otherwise(F.lit(first)).alias("candidate_split"),
            )
        )
    return reduce(DataFrame.unionByName, sides)


def nearest_across_splits(records: DataFrame, vector: str = "embedding", block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """For each class and pair of splits, every record of the smaller side with its best match opposite."""
    units = records.select("class", "split", "id", vectors.unit_vector(F.col(vector)).alias("unit"))
    units = materialise(units)
    points = materialise(units.groupBy("class", "split", "unit").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    placed, balls, levels = _ball_tree(points.select("class", "split", "id", "unit"), leaf)
    pairs = _query_sides(units).withColumns({"query_ball": F.lit(""), "candidate_ball": F.lit("")})
    for _ in range(levels):
        pairs = _nearer_pairs(pairs, balls)
    found = _over_leaves(pairs, placed, balls, block_rows) if levels else _compare_balls(pairs, placed, balls, block_rows)
    best = _best(found)
    single = points.filter(F.col("copies") == 1)
    copied = points.filter(F.col("copies") > 1).select("class", "split", "unit", F.col("id").alias("query_id"))
    members = single.select(F.col("id").alias("query_id"), F.col("id").alias("member")).unionByName(
        units.join(copied, ["class", "split", "unit"]).select("query_id", F.col("id").alias("member"))
    )
    return best.join(members, "query_id").select(
        "class", "query_split", "candidate_split", F.col("member").alias("query_id"), "candidate_id", "similarity"
    )


def _angle(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))


def _ball_tree(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """Vectors (class, split, id, unit, ball) in their leaves, balls (class, split, ball, parent, centre, radius, rows, leaf) and the depth.

    A ball is named by its path from the root, which is empty. Its centre is one of its vectors.
    """
    key = ["class", "split", "ball"]
    placed = points.withColumn("ball", F.lit(""))
    roots = placed.groupBy(*key).agg(F.min_by("unit", "id").alias("centre"), F.count("*").alias("rows"))
    balls = materialise(roots.select(*key, F.lit(None).cast("string").alias("parent"), "centre", F.lit(math.pi).alias("radius"), "rows", (F.col("rows") <= leaf).alias("leaf")))
    level, done, all_balls, levels = balls, [], [balls], 0
    while not level.filter(~F.col("leaf")).isEmpty():
        large = level.filter(~F.col("leaf")).select(*key, "rows")
        done.append(placed.join(level.filter("leaf").select(*key), key, "left_semi"))
        open_ = placed.join(large, key).withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / DEALT)))
        # a limit on ranks is taken in every task before the shuffle
        order = Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id")
        pivots = materialise(open_.withColumn("child", F.row_number().over(order)).filter(F.col("child") <= FAN).select(*key, "rows", "child", F.col("unit").alias("centre")))
        chunks = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("rows") / DEALT) - 1)))
        dealt = _dealt(open_, chunks, key)
        placed = dealt.select("class", "split", "id", "unit", F.col("child_ball").alias("ball"))
        sizes = dealt.groupBy("class", "split", F.col("ball").alias("parent"), F.col("child_ball").alias("ball")).agg(F.max("angle").alias("radius"), F.count("*").alias("rows"))
        named = pivots.select("class", "split", F.col("ball").alias("parent"), _child_name(F.col("ball"), F.col("child")).alias("ball"), "centre", F.col("rows").alias("parent_rows"))
        stuck = F.col("rows") > STUCK * F.col("parent_rows")
        level = materialise(sizes.join(named, ["class", "split", "parent", "ball"]).select(*key, "parent", "centre", "radius", "rows", ((F.col("rows") <= leaf) | stuck).alias("leaf")))
        all_balls.append(level)
        levels += 1
    return reduce(DataFrame.unionByName, [*done, placed]), reduce(DataFrame.unionByName, all_balls), levels


def _child_name(ball: Column, child: Column) -> Column:
    return F.concat(ball, child.cast("string"), F.lit("."))


def _dealt(open_: DataFrame, pivots: DataFrame, key: list[str]) -> DataFrame:
    """Each vector with the nearest pivot of its ball, as (class, split, ball, id, unit, child_ball, angle)."""
    names = [*key, "id", "unit", "child_ball", "angle"]
    fields = [f"{c} {open_.schema[c].dataType.simpleString()}" for c in (*key, "id")]

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or near.empty:
            return pd.DataFrame(columns=names)
        near = near.sort_values("child")
        angles = np.arccos(np.clip(np.stack(rows["unit"].to_numpy()) @ np.stack(near["centre"].to_numpy()).T, -1.0, 1.0))
        child = angles.argmin(axis=1)
        ball = rows["ball"].iloc[0]
        path = np.array([f"{ball}{c}." for c in near["child"]], dtype=object)
        return rows.assign(child_ball=path[child], angle=angles[np.arange(len(rows)), child])[names]

    by = [*key, "chunk"]
    left = open_.select(*by, "id", "unit").groupBy(*by)
    return materialise(left.cogroup(pivots.select(*by, "child", "centre").groupBy(*by)).applyInPandas(assign, f"{', '.join(fields)}, unit array<double>, child_ball string, angle double"))


def _side(pairs: DataFrame, balls: DataFrame, side: str, on: str) -> DataFrame:
    """``pairs`` with ball, centre and radius of one side; ``on`` is the column of ``balls`` that holds the ball to look up."""
    listed = balls.select(
        "class", F.col("split").alias(f"{side}_split"), F.col(on).alias(f"{side}_up"), F.col("ball").alias(f"{side}_down"),
        F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius"),
    )
    found = pairs.withColumnRenamed(f"{side}_ball", f"{side}_up").join(listed, ["class", f"{side}_split", f"{side}_up"])
    return found.drop(f"{side}_up").withColumnRenamed(f"{side}_down", f"{side}_ball")


def _nearer_pairs(pairs: DataFrame, balls: DataFrame) -> DataFrame:
    """Pairs of the children (of a leaf: itself) that can hold a nearest neighbour."""
    down = balls.filter(F.col("parent").isNotNull()).withColumn("up", F.col("parent")).unionByName(balls.filter("leaf").withColumn("up", F.col("ball")))
    both = _side(_side(pairs, down, "query", "up"), down, "candidate", "up")
    apart = both.withColumn("apart", _angle(F.col("query_centre"), F.col("candidate_centre")))
    # a centre is a vector, so every query of the ball has one within this angle
    sure = apart.groupBy("class", "query_split", "candidate_split", "query_ball").agg(F.min(F.col("apart") + F.col("query_radius")).alias("sure"))
    kept = apart.join(sure, ["class", "query_split", "candidate_split", "query_ball"]).filter(F.col("apart") - F.col("query_radius") - F.col("candidate_radius") <= F.col("sure") + SLACK)
    return materialise(kept.select("class", "query_split", "candidate_split", "query_ball", "candidate_ball"))


def _members(pairs: DataFrame, placed: DataFrame, side: str) -> DataFrame:
    """The vectors of one side of every pair of leaves."""
    own = placed.select("class", F.col("split").alias(f"{side}_split"), F.col("ball").alias(f"{side}_ball"), "id", "unit")
    return own.join(pairs, ["class", f"{side}_split", f"{side}_ball"])


def _sized(pairs: DataFrame, balls: DataFrame, side: str) -> DataFrame:
    sizes = balls.filter("leaf").select("class", F.col("split").alias(f"{side}_split"), F.col("ball").alias(f"{side}_ball"), F.col("rows").alias(f"{side}_rows"))
    return pairs.join(sizes, ["class", f"{side}_split", f"{side}_ball"])


def _compare_balls(pairs: DataFrame, placed: DataFrame, balls: DataFrame, block_rows: int) -> DataFrame:
    cell = ["class", "query_split", "candidate_split", "query_ball", "candidate_ball"]
    pairs = materialise(pairs.select(*cell))
    plan = materialise(_sized(_sized(pairs, balls, "query"), balls, "candidate"))
    return _compare(_members(pairs, placed, "query"), _members(pairs, placed, "candidate"), cell, plan, block_rows)


def _over_leaves(pairs: DataFrame, placed: DataFrame, balls: DataFrame, block_rows: int) -> DataFrame:
    """The nearest leaf of every query leaf first; then those that can still hold something closer, query by query."""
    group = ["class", "query_split", "candidate_split"]
    both = _side(_side(pairs, balls.filter("leaf"), "query", "ball"), balls.filter("leaf"), "candidate", "ball")
    both = materialise(both.withColumn("apart", _angle(F.col("query_centre"), F.col("candidate_centre"))))
    first = both.groupBy(*group, "query_ball").agg(F.min_by("candidate_ball", F.struct("apart", "candidate_ball")).alias("candidate_ball"))
    first = materialise(first)
    at_home = materialise(_best(_compare_balls(first, placed, balls, block_rows)))

    bounds = at_home.select(*group, F.col("query_id").alias("id"), F.acos(F.least(F.greatest("similarity", F.lit(-1.0)), F.lit(1.0))).alias("bound"))
    queries = placed.select("class", F.col("split").alias("query_split"), F.col("ball").alias("query_ball"), "id", "unit")
    bounded = materialise(queries.join(bounds, ["class", "query_split", "id"]))
    worst = bounded.groupBy(*group, "query_ball").agg(F.max("bound").alias("worst"))
    rest = both.join(first, [*group, "query_ball", "candidate_ball"], "left_anti").join(worst, [*group, "query_ball"])
    rest = rest.filter(F.col("apart") - F.col("query_radius") - F.col("candidate_radius") <= F.col("worst") + SLACK)
    visits = bounded.join(rest.select(*group, "query_ball", "candidate_ball", "candidate_centre", "candidate_radius"), [*group, "query_ball"])
    visits = visits.filter(_angle(F.col("unit"), F.col("candidate_centre")) - F.col("candidate_radius") <= F.col("bound") + SLACK)
    visits = materialise(visits.select(*group, "candidate_ball", "id", "unit"))
    cell = [*group, "candidate_ball"]
    counts = visits.groupBy(*cell).agg(F.count("*").alias("query_rows"))
    plan = materialise(_sized(counts, balls, "candidate"))
    elsewhere = _compare(visits, _members(plan.select(*cell), placed, "candidate"), cell, plan, block_rows)
    return at_home.unionByName(elsewhere)


def _once() -> Column:
    # an unordered pair comes from two rows at most, so these window partitions are tiny
    return F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("similarity"), "query_id"))


def top_neighbour_pairs(nearest: DataFrame, records: DataFrame, top: int = 200) -> DataFrame:
    """The most similar unordered pairs, each once, with review flags."""
    keyed = nearest.withColumn("_key", pair_key(F.col("query_id").cast("string"), F.col("candidate_id").cast("string")))
    once = keyed.withColumn("_n", _once()).filter("_n = 1")
    ranked = once.orderBy(F.desc("similarity"), "query_id", "candidate_id").limit(top)
    for side in ("query", "candidate"):
        objects = records.select(F.col("id").alias(f"{side}_id"), F.col("object").alias(f"{side}_object"))
        ranked = ranked.join(objects, f"{side}_id")
    return ranked.select(
        "class",
        split_pair(F.col("query_split"), F.col("candidate_split")).alias("split_pair"),
        "query_id",
        "candidate_id",
        "similarity",
        (F.col("similarity") >= flags.VERY_HIGH_COSINE).alias("very_high"),
        (F.col("similarity") >= flags.HIGH_COSINE).alias("high"),
        flags.involves_unmapped(F.col("query_object"), F.col("candidate_object")).alias("involves_unmapped"),
    )
