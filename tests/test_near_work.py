import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.operators import links, nearhash, review


def test_metrics_of_pairs_of_grids(spark):
    rng = np.random.default_rng(3)
    grids = [[int(x) for x in v] for v in rng.integers(0, 9, (40, 72))] + [[0] * 72, [2] * 72]
    rows = [(i, grids[i], grids[-1 - i]) for i in range(len(grids))]
    for r in review.measured_pairs(spark.createDataFrame(rows, "id bigint, grid_a array<int>, grid_b array<int>")).collect():
        a, b = np.array(grids[r.id], float), np.array(grids[-1 - r.id], float)
        norms = math.sqrt((a * a).sum() * (b * b).sum())
        assert r.embedding_cosine == pytest.approx((a * b).sum() / norms if norms else 0.0)
        assert r.correlation == pytest.approx(np.corrcoef(a, b)[0, 1] if a.std() and b.std() else 0.0)
        assert r.mae == pytest.approx(np.abs(a / max(a.max(), 1) - b / max(b.max(), 1)).mean())


def test_uneven_slots_get_tasks_by_their_comparisons(spark, monkeypatch):
    monkeypatch.setattr(nearhash, "TASK", 1e5)
    hashes = spark.range(6000).select(F.lit("a").alias("class"), F.col("id").alias("fp"), F.lit(3).alias("in_splits"))  # one slot of most bands
    cells, masks = nearhash._cells(hashes, "class", "in_splits", 4, None, nearhash.BLOCK)
    assert cells.rdd.getNumPartitions() > 6000 * len(masks) * nearhash.SLOT / 1e5


def test_few_contents_by_batch_and_many_by_tile_give_one_summary(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], ["train", "test"][i // 2 % 2], None if i % 3 else "o", int(i % 7), [int(x) for x in rng.integers(0, 3, 6) + 1]) for i in range(160)]
    records = spark.createDataFrame(rows, "id bigint, class string, split string, object string, fp bigint, grid array<int>")
    pairs = links.near_node_pairs(records, 3)
    found = [review.tiled_summary(pairs, records, few=few).first() for few in (0, 60, 10**6)]
    assert found[0].pairs > 0 and found[0].unmapped_pairs > 0
    for other in found[1:]:
        assert all(a == pytest.approx(b) for a, b in zip(found[0], other, strict=True))


def test_totals_where_pairs_are_found_equal_the_summary_of_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        fp = int(rng.choice([0, 1, 3, 255, -1, 1 << 40, (1 << 40) + 7, 0x0F0F0F0F0F0F0F0F]))
        big = [1, 300, 70_000][i % 3]  # numbers of one, two and eight bytes
        rows.append((i % 390, [None, "a", "b", "b"][i % 4], ["train", "test", "validation", "train", None][i % 5], [None, "o", "p", f"q{i // 9}"][int(rng.integers(4))], None if i % 50 == 0 else fp, [int(x) for x in rng.integers(0, 3, 6) * big + 1]))
    rows += rows[:40]
    records = spark.createDataFrame(rows, "id bigint, class string, split string, object string, fp bigint, grid array<int>")
    wanted = review.tiled_summary(links.near_node_pairs(records, 8), records).first().asDict()
    assert wanted["mapped_same_object"] > 0 and wanted["unmapped_pixel_flags"] > 0
    for size in (nearhash.BLOCK, 7):  # 7: cells of two blocks
        found = links.near_node_pairs(review.packed_contents(records), 8, size=size, totals=review.PAIR_TOTALS)
        assert review.tiled_summary(found, records, same_object=review.same_object_totals(records, 8)).first().asDict() == pytest.approx(wanted)
    empty = records.limit(0)
    nothing = review.tiled_summary(links.near_node_pairs(review.packed_contents(empty), 8, totals=review.PAIR_TOTALS), empty, same_object=review.same_object_totals(empty, 8)).first()
    assert nothing == review.tiled_summary(links.near_node_pairs(empty, 8), empty).first()


def test_no_row_per_pair_leaves_a_task(spark):
    records = spark.range(600).select("id", F.lit("a").alias("class"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit(None).cast("string").alias("object"), (F.col("id") % 256).alias("fp"), F.array(F.col("id") % 7 + 1, F.lit(2)).alias("grid"))
    found = links.near_node_pairs(review.packed_contents(records), 8, totals=review.PAIR_TOTALS)
    assert found.count() <= found.rdd.getNumPartitions()
    assert found.agg(F.sum("pairs")).first()[0] == 300 * 300
