"""Duplicates, near pairs and components against brute force, with hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from veriset.functions.vectors import signed64
from veriset.operators import cleanup, components, links, neighbours, profile, review
from veriset.operators.checks import ContractError
from veriset.plans import audit

SPLITS = ["train", "validation", "test"]


def random_records(n=300, seed=1, hot=0.33):
    """A third of all records are copies of one content; the rest are near and exact copies of a few."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(n):
        if rng.random() < hot:
            fp, digest, class_name = 0, "hot", "a"
        else:
            base = rng.randrange(len(bases))
            fp = bases[base]
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 4, 5, 8, 9])):
                fp ^= 1 << bit
            class_name, digest = "ab"[base % 2], f"d{fp:x}"
        leaf = None if rng.random() < 0.4 else f"{class_name}{rng.randrange(60)}"
        rows.append((i, class_name, rng.choice(SPLITS), digest, leaf, signed64(fp)))
    return rows


SCHEMA = "id bigint, class string, split string, digest string, object string, fp bigint"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(random_records(), SCHEMA).cache()


def brute(rows, same, crossing=True):
    return {
        (a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if (not crossing or a[2] != b[2]) and same(a, b)
    }


def distance(a, b):
    return bin((a[5] ^ b[5]) & (2**64 - 1)).count("1")


def counted(pairs, key):
    """Record pairs of brute force as (key of the pair of nodes) -> number."""
    found = {}
    for a, b in pairs:
        found[key(a, b)] = found.get(key(a, b), 0) + 1
    return found


def test_exact_pairs_and_members_equal_brute_force(records):
    rows = random_records()
    by_id = {r[0]: r for r in rows}
    expected = counted(brute(rows, lambda a, b: a[3] == b[3]), lambda a, b: (by_id[a][3], *sorted((by_id[a][2], by_id[b][2]))))
    found = links.exact_pairs(records).collect()
    assert {(r.digest, r.split_a, r.split_b): r.pairs for r in found} == expected and len(found) == len(expected)
    assert sum(r.pairs for r in links.exact_pair_totals(records).collect()) == sum(expected.values())
    groups = links.cross_split_groups(records, "digest")
    members = links.group_members(records, groups, "digest").collect()
    assert sorted(r.id for r in members) == sorted({i for p in brute(rows, lambda a, b: a[3] == b[3]) for i in p})


@pytest.mark.parametrize("threshold, bands, size", [(4, None, 16_384), (4, 6, 16_384), (8, None, 16_384), (4, 5, 3), (8, 9, 3), (8, 10, 2)])
def test_near_pairs_equal_brute_force(records, threshold, bands, size):
    rows = random_records()
    by_id = {r[0]: r for r in rows}
    pairs = brute(rows, lambda a, b: a[1] == b[1] and distance(a, b) <= threshold)

    def key(a, b):
        return (by_id[a][1], distance(by_id[a], by_id[b]), *sorted(((by_id[i][2], by_id[i][5]) for i in (a, b))))

    nodes = links.near_node_pairs(records, threshold, bands, size)
    found = nodes.collect()
    assert {(r["class"], r.distance, (r.split_a, r.fp_a), (r.split_b, r.fp_b)): r.pairs for r in found} == counted(pairs, key)
    assert len(found) == len(counted(pairs, key))
    assert {r.id for r in links.linked_ids(records, nodes).collect()} == {i for p in pairs for i in p}


def test_a_large_node_is_whole_in_ids_log_and_summary(spark):
    """200 x 200 copies of one fingerprint: 40,000 record pairs stand in one row, and every record is accounted for."""
    rng = random.Random(11)
    rows = [(i, "a", "train" if i < 200 else "test", f"d{i}", None if rng.random() < 0.5 else f"o{rng.randrange(20)}", 77, [i % 3, 5]) for i in range(400)]
    rows += [(500, "a", "validation", "v", "o1", 78, [1, 5])]
    records = spark.createDataFrame(rows, f"{SCHEMA}, grid array<int>")
    nodes = links.near_node_pairs(records, 4)
    pairs = brute(rows, lambda a, b: distance(a, b) <= 4)
    assert nodes.count() == 3 and nodes.agg(F.sum("pairs")).first()[0] == len(pairs) == 40_400
    assert {r.id for r in links.linked_ids(records, nodes).collect()} == {r[0] for r in rows}
    cleaned, log, _ = audit.quarantined_manifest(records)
    gone = cleanup.quarantined_records(records, cleanup.quarantined_nodes(nodes))
    assert {r.id for r in gone.collect()} == set(range(200)) | {500} == {r[0] for r in rows} - {r.id for r in cleaned.collect()}
    assert log.agg(F.sum("pairs")).first()[0] == len(pairs)
    described = review.content_pairs(nodes, records, "grid").withColumns({"embedding_cosine": F.lit(0.5), "mae": F.lit(0.5), "correlation": F.lit(0.5)})
    summary = review.review_summary(review.flagged_pairs(described), review.same_object_pairs(nodes, records)).first()
    by_id = {r[0]: r for r in rows}
    unmapped = [(a, b) for a, b in pairs if by_id[a][4] is None or by_id[b][4] is None]
    same = [(a, b) for a, b in pairs if by_id[a][4] is not None and by_id[a][4] == by_id[b][4]]
    assert (summary.pairs, summary.unmapped_pairs, summary.mapped_pairs, summary.mapped_same_object) == (len(pairs), len(unmapped), len(pairs) - len(unmapped), len(same))


@pytest.mark.parametrize("size", [7, 1024])
def test_tiles_sum_up_what_the_pairs_of_contents_say(spark, size):
    """A fingerprint with hundreds of contents on both sides, and others with few or constant ones."""
    from veriset.functions import vectors

    rng = random.Random(size)
    rows = []
    for i in range(500):
        fp = 77 if i < 400 else rng.choice([78, 79, 1 << 40])
        grid = [5] * 6 if rng.random() < 0.05 else [rng.choice([8, 9, 10]) if rng.random() < 0.8 else 1 for _ in range(6)]
        rows.append((i, "a", rng.choice(SPLITS), f"d{i}", None if rng.random() < 0.3 else f"o{rng.randrange(20)}", fp, grid))
    records = spark.createDataFrame(rows, f"{SCHEMA}, grid array<int>")
    nodes = links.near_node_pairs(records, 4).cache()
    a, b = (F.col(f"grid_{side}").cast("array<double>") for side in "ab")
    scaled = lambda g: F.transform(g, lambda x: x / F.array_max(g))
    described = review.content_pairs(nodes, records, "grid").withColumns({"embedding_cosine": vectors.cosine(a, b), "mae": vectors.mean_absolute_error(scaled(a), scaled(b)), "correlation": vectors.guarded_correlation(a, b)})
    wanted = review.review_summary(review.flagged_pairs(described), review.same_object_pairs(nodes, records)).first().asDict()
    found = review.tiled_summary(nodes, records, size=size).first().asDict()
    assert set(found) == set(wanted) and wanted["pairs"] > 10_000 and wanted["unmapped_pixel_flags"] > 0
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in wanted.items())
    none = review.tiled_summary(nodes.limit(0), records, size=size).first()
    assert none.pairs == 0 and none.max_cosine is None


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_near_pairs_do_not_depend_on_partitioning(spark, records, partitions):
    moved = records.repartition(partitions)
    found = links.near_node_pairs(moved, 4).agg(F.sum("pairs"), F.sum("distance")).first()
    base = links.near_node_pairs(records, 4).agg(F.sum("pairs"), F.sum("distance")).first()
    assert found == base


def union_find(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_equal_union_find(spark):
    rows = random_records(150, seed=3)
    records = spark.createDataFrame(rows, SCHEMA)
    edges = brute(
        rows,
        lambda a, b: a[3] == b[3] or (a[4] is not None and a[4] == b[4]) or (a[1] == b[1] and distance(a, b) <= 4),
        crossing=False,
    )
    expected = union_find([r[0] for r in rows], edges)
    found = {r.id: r.component for r in components.record_components(records).collect()}
    assert found == expected
    counts = {r.evidence: r.links for r in components.link_counts(records).collect()}
    assert counts["near"] == len(brute(rows, lambda a, b: a[1] == b[1] and distance(a, b) <= 4, crossing=False))
    assert counts["exact"] == len(rows) - len({r[3] for r in rows})


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i + 1, i) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(200)]
    edges = spark.createDataFrame(chain + hub, "big bigint, small bigint")
    found = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1201)}}


def test_a_component_over_two_classes_is_reported(spark):
    rows = [(1, "a", "train", "x", None, None), (2, "b", "test", "x", None, None), (3, "a", "test", "y", None, None)]
    table = components.component_table(components.record_components(spark.createDataFrame(rows, SCHEMA)))
    assert [r.component for r in components.mixed_components(table).collect()] == [1]


def test_quarantine_protects_the_test_split(records):
    cleaned, log, contract = audit.quarantined_manifest(records)
    rows = random_records()
    rank = {"train": 0, "validation": 1, "test": 2}
    pairs = brute(rows, lambda a, b: a[1] == b[1] and distance(a, b) <= 4)
    by_id = {r[0]: r for r in rows}
    gone = {min((a, b), key=lambda i: rank[by_id[i][2]]) for a, b in pairs}
    assert {r.id for r in cleaned.collect()} == set(by_id) - gone
    assert all(r.passed for r in contract.filter(F.col("check") != "class_in_every_split").collect())
    assert log.agg(F.sum("pairs")).first()[0] == len(pairs)


def test_listed_pairs_log_each_pair_but_remove_each_record_once(spark):
    manifest = spark.createDataFrame([("t1", "train"), ("t2", "train"), ("v", "validation"), ("e", "test")], "id string, split string")
    pairs = spark.createDataFrame([(1, "t1", "e"), (2, "t1", "v"), (3, "v", "e")], "distance int, id_a string, id_b string")
    log, cleaned = cleanup.quarantine_listed(pairs, manifest)
    assert log.count() == 3
    assert {(r.removed_id, r.protected_id) for r in log.collect()} == {("t1", "e"), ("t1", "v"), ("v", "e")}
    assert {r.id for r in cleaned.collect()} == {"t2", "e"}
    assert cleanup.surviving_listed(pairs, cleaned).count() == 0
    bad = spark.createDataFrame([(1, "t1", "t2"), (1, "t1", "nowhere")], "distance int, id_a string, id_b string")
    assert cleanup.misplaced_pairs(cleanup.located_pairs(bad, manifest)).count() == 2
    with pytest.raises(ContractError, match="two_known_splits"):
        cleanup.quarantine_listed(bad, manifest)


def test_records_without_a_digest_stay_in_the_components(spark):
    rows = [(1, "a", "train", None, None, None), (2, "a", "test", None, None, None), (3, "a", "test", "x", None, None)]
    found = components.record_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.id, r.component) for r in found} == {(1, 1), (2, 2), (3, 3)}


def test_safe_manifest_refuses_a_third_split(spark):
    rows = [(1, "a", "train", "x", None, None), (2, "a", "validation", "y", None, None), (3, "a", "test", "z", None, None)]
    with pytest.raises(ContractError, match="only_train_and_test"):
        audit.leakage_safe_manifest(spark.createDataFrame(rows, SCHEMA), 0.5)


def test_component_split_keeps_components_whole(spark):
    rng = random.Random(9)
    rows = [(i, "ab"[i % 2], "train", f"d{i % 2}{rng.randrange(60)}", None, None) for i in range(300)]
    placed = audit.component_split(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.id for r in placed) == list(range(300))
    assert all(len({r.split for r in placed if r.component == c}) == 1 for c in {r.component for r in placed})
    assert {r.split for r in placed} == set(SPLITS)
    mixed = [(1, "a", "train", "x", None, None), (2, "b", "train", "x", None, None)]
    with pytest.raises(ContractError, match="one_class"):
        audit.component_split(spark.createDataFrame(mixed, SCHEMA))


def test_null_objects_never_collide(spark):
    rows = [(1, "a", "train", "x", None, None), (2, "a", "test", "y", None, None), (3, "a", "train", "y", "o", None), (4, "a", "train", "z", "p", None), (5, "a", "test", "w", "p", None)]
    kept, log = cleanup.clean_against_test(spark.createDataFrame(rows, SCHEMA))
    assert [r.id for r in kept.collect()] == [1]
    assert {(r.id, r.reason) for r in log.collect()} == {(3, "exact_digest_overlap_with_test"), (4, "object_overlap_with_test")}


def test_exactly_one_lookup(spark):
    listed = spark.createDataFrame([("x/a/F.jpg",), ("x/a/g.jpg",), ("x/b/none.jpg",), ("short",)], "line string")
    index = spark.createDataFrame([("a", "f.jpg", 1), ("a", "g.jpg", 2), ("a", "g.jpg", 3)], "class_name string, file_key string, page int")
    resolved = cleanup.resolve_once(cleanup.parsed_list(listed), index, ["class_name", "file_key"], ["page"])
    assert {(r.line, r.local_match_count, r.page) for r in resolved.collect()} == {
        ("x/a/F.jpg", 1, 1), ("x/a/g.jpg", 2, None), ("x/b/none.jpg", 0, None), ("short", 0, None),
    }
    assert cleanup.matched(resolved).count() == 1 and cleanup.unmatched(resolved).count() == 3


def test_listed_manifest_contract(spark):
    index = spark.createDataFrame([("a", "f.jpg", "p1"), ("a", "g.jpg", "p2")], "class_name string, file_key string, path string")
    lists = {
        "train": spark.createDataFrame([("x/a/F.jpg",), ("x/a/g.JPG",)], "line string"),
        "test": spark.createDataFrame([("y/a/f.jpg",), ("y/b/q.jpg",)], "line string"),
    }
    resolved, contract = audit.listed_manifest(lists, index)
    assert resolved.count() == 4
    assert {r.check: r.violations for r in contract.collect()} == {
        "index_keys_are_unique": 0, "every_line_matches_once": 1, "no_file_listed_twice": 1,
    }


def test_object_resolution(spark):
    records = spark.createDataFrame([(i, c) for i, c in enumerate(["k", "k", "k", "k", "k"])], "id int, class string")
    records = records.withColumn("identifier", F.col("id").cast("string"))
    suggestions = spark.createDataFrame(
        [("0", ["only"]), ("1", []), ("2", ["zz", "has k in it", "k2"]), ("3", ["zz", "yy"])], "identifier string, suggestions array<string>"
    )
    found = {r.id: r.object for r in cleanup.resolve_objects(records, suggestions).collect()}
    assert found == {0: "only", 1: None, 2: "has k in it", 3: None, 4: None}


@pytest.mark.parametrize("block_rows, leaf", [(7, 4096), (8192, 4096), (8192, 20), (9, 5)])
def test_nearest_neighbours_equal_brute_force(spark, block_rows, leaf):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(180):
        # copies, near-identical vectors that angles cannot part, and others
        vector = base[0] if i % 3 == 0 else base[1] + rng.normal(size=8) * 1e-9 if i % 3 == 1 and i < 120 else base[rng.integers(6)] + rng.normal(size=8) * 0.2
        rows.append((i, int(i % 2), SPLITS[int(rng.integers(3))], None, [float(x) for x in vector]))
    records = spark.createDataFrame(rows, "id bigint, class int, split string, object string, embedding array<double>")
    unit = {r[0]: np.array(r[4]) / np.linalg.norm(r[4]) for r in rows}
    expected = {}
    for class_index in (0, 1):
        for first, second in neighbours.SPLIT_PAIRS:
            a = [r[0] for r in rows if r[1] == class_index and r[2] == first]
            b = [r[0] for r in rows if r[1] == class_index and r[2] == second]
            queries, candidates = (a, b) if len(a) <= len(b) else (b, a)
            for q in queries:
                expected[(q, frozenset((first, second)))] = max(float(unit[q] @ unit[c]) for c in candidates)
    found = neighbours.nearest_across_splits(records, block_rows=block_rows, leaf=leaf).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r.similarity == pytest.approx(expected[(r.query_id, frozenset((r.query_split, r.candidate_split)))])
        assert float(unit[r.query_id] @ unit[r.candidate_id]) == pytest.approx(r.similarity)


def test_empty_results_keep_their_columns(spark):
    rows = [(1, "a", "train", "x", None, 5), (2, "a", "train", "x", None, 5)]
    records = spark.createDataFrame(rows, SCHEMA)
    assert links.exact_pairs(records).collect() == [] and "first_id_a" in links.exact_pairs(records).columns
    assert links.near_node_pairs(records, 4).count() == 0
    assert profile.missing_class_splits(records).count() == 2
