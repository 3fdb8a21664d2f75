"""Near hashes by blocks: pairs, forests and counts against brute force, in dense balls and over many small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from veriset.functions.vectors import signed64
from veriset.operators import components, nearhash


def ball(seed, size, most=3):
    """Hashes around one centre, and some anywhere."""
    rng = random.Random(seed)
    centre, found = rng.getrandbits(64), set()
    while len(found) < size:
        value = centre if rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, most + 2)):
            value ^= 1 << bit
        found.add((rng.choice("ab"), value))
    return sorted(found)


def brute(rows, threshold):
    return [(i, j) for i, a in enumerate(rows) for j in range(i + 1, len(rows)) if a[0] == rows[j][0] and (a[1] ^ rows[j][1]).bit_count() <= threshold]


def grouped(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return {frozenset(i for i in range(n) if find(i) == r) for r in {find(i) for i in range(n)}}


@pytest.mark.parametrize("threshold, bands, size", [(4, None, 16_384), (4, 6, 50), (8, 9, 20), (8, 11, 100)])
def test_forest_and_count_equal_brute_force(spark, threshold, bands, size):
    rows = ball(threshold + size, 400)
    pairs = brute(rows, threshold)
    place = {(c, signed64(f)): i for i, (c, f) in enumerate(rows)}
    df = spark.createDataFrame([(c, signed64(f), i % 3 + 1) for i, (c, f) in enumerate(rows)] + [(None, 5, 1), (None, 4, 1)], "class string, fp bigint, copies bigint")
    links = nearhash.near_forest(df, "class", threshold, bands, size).collect()
    forest = [(place[r["class"], r.fp_a], place[r["class"], r.fp_b]) for r in links]
    assert set(map(frozenset, forest)) <= set(map(frozenset, pairs))
    assert grouped(forest, len(rows)) == grouped(pairs, len(rows))
    total = nearhash.near_count(df, "class", threshold, "copies", bands, size).first().links
    assert total == sum((i % 3 + 1) * (j % 3 + 1) for i, j in pairs)
    listed = nearhash.near_hashes(df.withColumn("in_splits", F.lit(7)), "class", threshold, bands, size).collect()
    assert sorted(tuple(sorted((place[r["class"], r.fp_a], place[r["class"], r.fp_b]))) for r in listed) == pairs


def test_links_of_a_large_ball_are_linear(spark):
    """100,000 hashes within a few bits of one centre: hundreds of millions of pairs, and fewer links than five per hash."""
    rng = random.Random(8)
    found = set()
    while len(found) < 100_000:
        found.add(signed64(sum(1 << b for b in rng.sample(range(64), rng.randint(2, 4)))))
    df = spark.createDataFrame([("a", f) for f in found], "class string, fp bigint")
    links = nearhash.near_forest(df, "class", 4)
    assert links.count() <= 5 * len(found)
    placed = components.connected_components(links.select(F.col("fp_a").alias("big"), F.col("fp_b").alias("small")))
    assert placed.count() == len(found) and placed.select("component").distinct().count() == 1


def test_bands_grow_with_the_hashes():
    chosen = [nearhash.choose_bands(n, 4) for n in (1, 10**4, 10**7, 10**9, 10**11)]
    assert chosen == sorted(chosen) and chosen[0] == 5 and chosen[-1] > 5
