"""Split builders against sequential reference computations written here."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriset.functions.names import hash60
from veriset.operators.checks import ContractError
from veriset.operators import checks, prefix, profile, splits


def test_running_sums_of_a_hot_key_match_pandas(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(100)) for i in range(500)]
    rows.append((None, 1000, 7))
    df = spark.createDataFrame(rows, "key string, pos bigint, v bigint").repartition(7)
    found = prefix.running_sums(df, ["key"], ["pos"], {"before": F.col("v")}, following={"next_v": F.col("v")}).toPandas()
    frame = pd.DataFrame(rows, columns=["key", "pos", "v"]).sort_values("pos")
    groups = frame.groupby("key", dropna=False)["v"]
    frame["before"], frame["next_v"] = groups.cumsum() - frame["v"], groups.shift(-1)
    both = found.merge(frame, on="pos", suffixes=("", "_expected"))
    assert len(both) == len(rows)
    assert (both["before"] == both["before_expected"]).all()
    assert (both["next_v"].fillna(-1) == both["next_v_expected"].fillna(-1)).all()


def test_hash_ranks_are_consecutive(spark):
    df = spark.range(1000).withColumn("class", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    ranked = prefix.rank_by_hash(df, ["class"], "s").toPandas()
    for _, group in ranked.groupby("class"):
        assert sorted(group["rank"]) == list(range(1, len(group) + 1))


def groups_frame(spark, seed, classes=3, groups=60):
    rng = random.Random(seed)
    rows = [(f"c{c}", f"g{g}", rng.choice([1, 1, 1, 2, 3, 5, 40])) for c in range(classes) for g in range(groups)]
    return rows, spark.createDataFrame(rows, "class string, group string, size bigint")


def hash_order(spark, df, salt):
    hashed = df.withColumn("h", hash60(F.lit(f"{salt}:42:"), F.col("class"), F.lit(":"), F.col("group")))
    return {(r["class"], r["group"]): r.h for r in hashed.collect()}


@pytest.mark.parametrize("fraction", [0.1, 0.25, 0.9])
def test_validation_prefix_equals_the_sequential_rule(spark, fraction):
    rows, df = groups_frame(spark, 4)
    order = hash_order(spark, df, "validation")
    found = {(r["class"], r["group"]): r.split for r in splits.validation_prefix(df, fraction).collect()}
    for class_name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == class_name), key=lambda r: (order[r[:2]], r[1]))
        target, taken = max(1, round(sum(r[2] for r in own) * fraction)), 0
        for i, r in enumerate(own):
            validation = taken < target and i < len(own) - 1
            taken += r[2] if validation else 0
            assert found[r[:2]] == ("validation" if validation else "train")


def test_validation_prefix_rounds_half_to_even_and_keeps_one_group_in_train(spark):
    df = spark.createDataFrame([("a", f"g{i}", 1) for i in range(25)], "class string, group string, size bigint")
    counts = Counter(r.split for r in splits.validation_prefix(df, 0.1).collect())
    assert counts == {"validation": 2, "train": 23}  # 2.5 rounds to 2
    two = spark.createDataFrame([("a", "x", 1), ("a", "y", 99)], "class string, group string, size bigint")
    assert Counter(r.split for r in splits.validation_prefix(two, 0.9).collect()) == {"validation": 1, "train": 1}


def sequential_greedy(sizes, weights=(8, 1, 1)):
    filled, out = [0, 0, 0], Counter()
    total = sum(sizes)
    targets = [total * w / 10 for w in weights]
    for i, size in enumerate(sorted(sizes, reverse=True)):
        if i < 3:
            k = i
        elif min(targets) < 1:
            k = max(range(3), key=lambda j: ((targets[j] - filled[j]) / max(targets[j], 1), -j))
        else:
            k = min(range(3), key=lambda j: (filled[j] * 8 // weights[j], j))
        filled[k] += size
        out[(size, k)] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_runs_equal_stepping_through_the_groups(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        n = rng.choice([3, 4, 7, 30, 200, 1500])
        rows += [(f"c{c}", f"g{i}", rng.choice([1, 1, 1, 2, 3, 17, 90])) for i in range(n)]
    df = spark.createDataFrame(rows, "class string, group string, size bigint")
    found = splits.greedy_run_table(df).collect()
    for class_name in {r[0] for r in rows}:
        expected = sequential_greedy([r[2] for r in rows if r[0] == class_name])
        for run in (r for r in found if r["class"] == class_name):
            assert [run.n_train, run.n_validation, run.n_test] == [expected[(run["size"], k)] for k in range(3)], class_name


def test_greedy_split_keeps_groups_whole_and_ratios_close(spark):
    rows, df = groups_frame(spark, 9, groups=400)
    assigned = splits.greedy_split(df).collect()
    assert len(assigned) == len(rows)
    for class_name in {r[0] for r in rows}:
        own = [r for r in assigned if r["class"] == class_name]
        total = sum(r["size"] for r in own)
        for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(sum(r["size"] for r in own if r.split == split) / total - share) < 0.03
    assert splits.too_few_groups(df.filter("group in ('g1', 'g2')"), 3).count() == 3


def test_one_dominant_group(spark):
    df = spark.createDataFrame([("a", "big", 1000)] + [("a", f"g{i}", 1) for i in range(50)], "class string, group string, size bigint")
    by_split = Counter()
    for r in splits.greedy_split(df).collect():
        by_split[r.split] += r["size"]
    assert by_split["train"] == 1000 and by_split["validation"] == by_split["test"] == 25


def test_half_split_totals(spark):
    sizes = {"a": 7, "b": 5, "c": 4, "d": 1}
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    halves = splits.half_split(spark.createDataFrame(rows, "id bigint, class string")).collect()
    per_class = Counter((r["class"], r.split) for r in halves)
    assert sum(r.split == "test" for r in halves) == 9  # ceil(17 / 2)
    for c, n in sizes.items():
        assert per_class[(c, "test")] in (n // 2, (n + 1) // 2)


def test_balanced_sample_and_shortage(spark):
    rows = [(i, "a" if i < 90 else "b") for i in range(95)]
    df = spark.createDataFrame(rows, "id bigint, class string")
    assert Counter(r["class"] for r in splits.balanced_sample(df, 5).collect()) == {"a": 5, "b": 5}
    assert [r["class"] for r in splits.short_classes(df, 6).collect()] == ["b"]
    with pytest.raises(ContractError, match="enough_records"):
        splits.balanced_sample(df, 6)


def test_permutation_keeps_the_label_counts(spark):
    rows = [(i, i % 7 if i % 2 else 0) for i in range(400)]
    permuted = splits.permuted_labels(spark.createDataFrame(rows, "id bigint, class int")).collect()
    assert len(permuted) == 400
    assert Counter(r.permuted for r in permuted) == Counter(c for _, c in rows)
    assert sum(r["class"] == r.permuted for r in permuted) < 300


def test_checks(spark):
    rows = [(1, "a", "train", "x"), (2, "a", "validation", "x"), (3, "b", "test", "y"), (4, "b", "dev", None)]
    df = spark.createDataFrame(rows, "id bigint, class string, split string, digest string")
    found = {r.check: r.violations for r in checks.split_integrity(df, ["digest"]).collect()}
    assert found == {"digest_in_one_split": 1, "class_in_every_split": 3, "split_names": 1}
    with pytest.raises(checks.ContractError, match="digest_in_one_split: 1"):
        checks.enforce(checks.split_integrity(df, ["digest"]))
    with pytest.raises(checks.ContractError, match="missing"):
        checks.require_columns(df, {"id", "missing"})
    assert checks.check_count("n", df, 4).first().passed
    summary = spark.createDataFrame([("train", 1), ("validation", 2)], "split string, records bigint")
    assert {r.split for r in checks.summary_mismatches(df, summary).collect()} == {"validation", "test", "dev"}
    overlaps = spark.createDataFrame([(0, 3)], "leaf_overlap int, path_overlap int")
    assert [r.field for r in checks.nonzero_fields(overlaps, ["leaf_overlap", "path_overlap"]).collect()] == ["path_overlap"]
    gaps = spark.createDataFrame([(0,), (2,)], "class_index int")
    assert checks.index_gaps(gaps).count() == 1
    assert profile.repeated_keys(df, "class").count() == 2


def test_run_metadata_contract(spark):
    rows = [("r", "r", "p", False, 10), ("r", "s", "p", False, 10), ("t", "t", "p", True, 10), ("u", "u", "p", None, 9)]
    runs = spark.createDataFrame(rows, "run_name string, config_run_name string, protocol string, test_used_during_training boolean, test_examples bigint")
    assert {r.run_name + str(r.config_run_name) for r in checks.run_metadata_violations(runs, "p", 10).collect()} == {"rs", "tt", "uu"}
