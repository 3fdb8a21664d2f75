"""Run histories, comparisons and examples."""

import random

import pytest
from pyspark.sql import functions as F

import golden
from veriset.operators import runs


def history(spark, series):
    rows = [(name, e, f1, loss) for name, run in series.items() for e, loss, f1 in run]
    return spark.createDataFrame(rows, "run string, epoch int, f1 double, loss double").repartition(3)


def sequential(run, patience=None, gain=1e-4):
    best, chain, idle = None, [], 0
    for position, (epoch, loss, f1) in enumerate(sorted(run), 1):
        if best is None or f1 > best[1] + gain or (abs(f1 - best[1]) <= gain and loss < best[0]):
            best, idle = (loss, f1, epoch), 0
            chain.append((epoch, position))
        else:
            idle += 1
        if patience and idle >= patience:
            return chain, position
    return chain, len(run)


def random_series(seed, runs_=8):
    rng = random.Random(seed)
    return {
        f"r{i}": [(e, rng.choice([0.1, 0.2, 0.3]), round(0.5 + rng.choice([0, 0.00005, 0.0001, 0.0002, 0.1]) * rng.random(), 5)) for e in range(1, rng.randrange(2, 60))]
        for i in range(runs_)
    }


def test_best_epoch_of_the_published_runs(spark):
    df = history(spark, {"long": golden.LONG_RUN, "short": golden.SHORT_RUN})
    found = {r.run: r.best_epoch for r in runs.best_epoch(runs.improvement_chain(df)).collect()}
    assert found == {"long": golden.LONG_BEST, "short": golden.SHORT_BEST}
    stopped = {r.run: r for r in runs.early_stop(runs.improvement_chain(df), 2).collect()}
    assert stopped["short"].effective_epochs == 8 and stopped["short"].best_epoch == 6 and stopped["short"].stopped_early


def test_summaries_lead_every_state_where_the_rule_does():
    """Blocks of tight series, entered with states on and around the tolerance."""
    import numpy as np

    rng = random.Random(4)
    for turn in range(300):
        gain = 1e-4
        steps = [0.5 + gain * rng.choice([0, 1, 2, 3, 0.5, -1]) for _ in range(rng.randint(1, 40))]
        f1, loss = np.array(steps), np.array([rng.choice([0.1, 0.2, 0.3, 0.15]) for _ in steps])
        summary = runs._summary(f1, loss, gain)
        for state in [(0.5 + gain * k, x) for k in (-1, 0, 0.5, 1, 2) for x in (0.05, 0.12, 0.4)]:
            chain = runs._chain(f1, loss, 0, state, gain)
            first = next((r for r in summary if runs._beats(r[0], r[1], *state, gain)), None)
            assert (first[2:] if first else None) == ((len(chain), f1[chain[-1]], loss[chain[-1]]) if chain else None)


def test_a_hot_run_lies_in_many_blocks(spark):
    rng = random.Random(6)
    run = [(e, rng.choice([0.1, 0.2, 0.3]) + rng.random() / 1000, round(0.5 + rng.random() * 0.0005, 6)) for e in range(20_000)]
    df = history(spark, {"hot": run, "small": run[:3]})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chain = runs.improvement_chain(df).where("run = 'hot'").orderBy("step").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.epoch, r.position) for r in chain] == sequential(run)[0]
    assert [r.step for r in chain] == list(range(1, len(chain) + 1)) and {r.epochs for r in chain} == {20_000}


@pytest.mark.parametrize("partitions", [1, 7])
def test_chain_equals_the_sequential_rule_for_short_and_long_runs(spark, partitions):
    series = random_series(7)
    chain = runs.improvement_chain(history(spark, series).repartition(partitions))
    found = {}
    for r in chain.orderBy("step").collect():
        found.setdefault(r.run, []).append((r.epoch, r.position))
    assert found == {name: sequential(run)[0] for name, run in series.items()}
    for patience in (1, 3, 8):
        stopped = {r.run: (r.best_epoch, r.effective_epochs) for r in runs.early_stop(chain, patience).collect()}
        for name, run in series.items():
            expected_chain, expected_epochs = sequential(run, patience)
            assert stopped[name] == (expected_chain[-1][0], expected_epochs)


def test_a_run_that_improves_in_each_of_many_epochs(spark):
    long = spark.range(50_000).select(F.lit("long").alias("run"), F.col("id").alias("epoch"), (F.col("id") * 2e-4).alias("f1"), F.lit(1.0).alias("loss"))
    chain = runs.improvement_chain(long.union(spark.createDataFrame([("x", 1, 0.5, 1.0)], long.schema)))
    assert chain.count() == 50_001
    assert {(r.run, r.best_epoch, r.epochs) for r in runs.best_epoch(chain).collect()} == {("long", 49_999, 50_000), ("x", 1, 1)}


def test_best_and_last_takes_the_earliest_of_equal_rows(spark):
    df = history(spark, {"a": [(1, 0.5, 0.7), (2, 0.4, 0.9), (3, 0.3, 0.9), (4, 0.2, 0.1)]})
    row = runs.best_and_last(df).first()
    assert (row.best_epoch, row.best_loss, row.epochs_completed, row.final_f1) == (2, 0.4, 4, 0.1)


def test_published_seed_stability(spark):
    df = spark.createDataFrame([(a,) for a in golden.SEED_ACCURACY], "test_accuracy double")
    row = runs.seed_stability(df, ["test_accuracy"]).first()
    assert row["mean"] == pytest.approx(golden.SEED_MEAN, abs=1e-9)
    assert row["std"] == pytest.approx(golden.SEED_STD, abs=1e-9)
    assert row.range_pp == pytest.approx(0.45755907)


def test_gap_and_epoch_lookup(spark):
    schema = "run string, epoch int, train_accuracy double, train_eval_accuracy double, validation_accuracy double, train_eval_macro_f1 double, validation_macro_f1 double"
    hist = spark.createDataFrame([("a", 1, 0.5, 0.6, 0.55, 0.5, 0.45), ("a", 2, 0.7, 0.8, 0.75, 0.7, 0.65)], schema)
    picked = runs.at_best_epoch(hist, spark.createDataFrame([("a", 2), ("b", 1)], "run string, best_epoch int"))
    assert {r.run: r.matches for r in picked.collect()} == {"a": 1, "b": 0}
    test = spark.createDataFrame([("a", 0.74, 0.66)], "run string, test_accuracy double, test_macro_f1 double")
    row = runs.generalization_gap(picked, test).first()
    assert row.clean_train_minus_validation_pp == pytest.approx(5.0) and row.validation_minus_test_macro_f1 == pytest.approx(-0.01)


def test_comparison_falls_back_over_field_names(spark):
    schema = "run string, total_parameters bigint, trainable_parameters bigint, epochs_completed int, training_minutes double, test_accuracy double, test_macro_f1 double, test_examples bigint, errors bigint, test_errors bigint"
    rows = [("a", 1000, 10, 1, 1.0, 0.9, 0.8, 100, 5, None), ("b", None, 500, 1, 1.0, 0.9, 0.85, 100, None, 6), ("c", 700, None, 1, 1.0, 0.875, 0.85, 100, None, None)]
    table = runs.comparison_table(spark.createDataFrame(rows, schema))
    assert {r.run: (r.parameters, r.errors) for r in table.collect()} == {"a": (1000, 5), "b": (500, 6), "c": (700, 12)}
    row = runs.winner_and_reduction(table, "a", "b").first()
    assert row.winner == "b" and row.parameter_reduction == pytest.approx(0.5)
    assert runs.different_sizes(table).count() == 0 and runs.different_sizes(table, 99).count() == 3


def test_diverse_examples_fill_up_in_order(spark):
    rows = [(i, i % 2, 0 if i % 5 else 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, true_index int, predicted_index int").withColumn("correct", __import__("pyspark").sql.functions.expr("true_index = predicted_index"))
    picked = [r.id for r in runs.diverse_examples(df, 5, True).collect()]
    correct = [i for i, t, p in rows if t == p]
    firsts = sorted({t: i for i, t, p in reversed(rows) if t == p}.values())
    assert picked == (firsts + [i for i in correct if i not in firsts])[:5]
