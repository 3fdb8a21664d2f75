"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.session import materialise


def _contract(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours (both ways: the larger ones; else: the smaller ones) of each node on the least of them."""
    edges = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = edges.join(least, "a")
    if both_ways:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one comparable type); root is the least node reached.

    Links may repeat, point either way or to themselves. Every round is written, so a lost executor costs one round.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = None
    while True:
        pairs = materialise(_contract(_contract(pairs, True), False))
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == mark:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
