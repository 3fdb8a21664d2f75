"""Comparisons over training runs: histories, seeds, gaps and examples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions import flags
from veriset.session import materialise

MIN_GAIN = 1e-4


# --- best epoch and early stop -------------------------------------------------------------


def improvement_chain(history: DataFrame, min_gain: float = MIN_GAIN) -> DataFrame:
    """(run, step, epoch, position, f1, loss, epochs): every epoch that replaced the best one.

    ``history`` is (run, epoch, f1, loss). F1 and loss of the best epoch move together, and the tolerance makes the rule
    depend on the previous choice. Still a run is folded in blocks: once an epoch of a block is chosen, the rest of the block
    is settled, and the first chosen one is never one that an earlier epoch of the block equals or beats in both F1 and loss.
    So a block is summed up by its few unbeaten epochs and where each of them leads. The summaries of a run are read in
    order, which gives every block its incoming state, and the blocks are then replayed side by side.
    """
    columns = history.select("run", F.col("epoch").cast("bigint").alias("epoch"), F.col("f1").cast("double").alias("f1"), F.col("loss").cast("double").alias("loss"))
    kind = columns.schema["run"].dataType.simpleString()
    order = ["run", "epoch", "f1", "loss"]
    # Ranges of the order are the blocks; written, so that every pass sees the same ones.
    ranged = columns.repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    blocks = materialise(ranged.sortWithinPartitions(*order))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for run, block, rows in _segments(batches):
            found.append((run, block, len(rows), _summary(rows["f1"].to_numpy(), rows["loss"].to_numpy(), min_gain)))
            if len(found) >= 1000:
                yield pd.DataFrame(found, columns=["run", "block", "epochs", "records"])
                found = []
        yield pd.DataFrame(found, columns=["run", "block", "epochs", "records"])

    schema = f"run {kind}, block int, epochs bigint, records array<struct<f1:double,loss:double,steps:bigint,exit_f1:double,exit_loss:double>>"
    summaries = materialise(blocks.repartition("run", "block").sortWithinPartitions("run", "block", "epoch", "f1", "loss").select("run", "block", "f1", "loss").mapInPandas(summed, schema))

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state, step, position = object(), None, 0, 0
        for batch in batches:
            found = []
            for name, block, epochs, records in zip(batch["run"], batch["block"], batch["epochs"], batch["records"], strict=True):
                if name != run and not (name is None and run is None):
                    run, state, step, position = name, None, 0, 0
                f1, loss = state or (None, None)
                found.append((name, block, f1, loss, step, position))
                for record in records:
                    if state is None or _beats(record["f1"], record["loss"], *state, min_gain):
                        state, step = (record["exit_f1"], record["exit_loss"]), step + record["steps"]
                        break
                position += epochs
            yield pd.DataFrame(found, columns=["run", "block", "in_f1", "in_loss", "step", "position"]).astype({"in_f1": float, "in_loss": float})

    # A run's summaries: one row for each of its blocks.
    states = summaries.repartition("run").sortWithinPartitions("run", "block").mapInPandas(entered, f"run {kind}, block int, in_f1 double, in_loss double, step bigint, position bigint")
    named = states.select(F.col("run").alias("_run"), F.col("block").alias("_block"), "in_f1", "in_loss", "step", "position")
    placed = blocks.join(named, F.col("run").eqNullSafe(F.col("_run")) & (F.col("block") == F.col("_block")))

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, _, rows in _segments(batches):
            f1, loss = rows["f1"].to_numpy(), rows["loss"].to_numpy()
            first = rows.iloc[0]
            state = None if first["position"] == 0 else (first["in_f1"], first["in_loss"])
            chosen = _chain(f1, loss, 0, state, min_gain)
            if chosen:
                found = rows.iloc[chosen][["epoch", "f1", "loss"]].assign(step=int(first["step"]) + np.arange(1, len(chosen) + 1), position=int(first["position"]) + np.array(chosen) + 1)
                yield found.assign(run=[run] * len(chosen))[["run", "step", "epoch", "position", "f1", "loss"]]

    ordered = placed.select("run", "block", "epoch", "f1", "loss", "in_f1", "in_loss", "step", "position").repartition("run", "block").sortWithinPartitions("run", "block", "epoch", "f1", "loss")
    chain = ordered.mapInPandas(replayed, f"run {kind}, step int, epoch bigint, position bigint, f1 double, loss double")
    lengths = summaries.groupBy(F.col("run").alias("_run")).agg(F.sum("epochs").alias("epochs"))
    return chain.join(lengths, F.col("run").eqNullSafe(F.col("_run"))).drop("_run")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, int, pd.DataFrame]]:
    """(run, block, rows) of every block, from sorted batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        runs, blocks = pd.factorize(batch["run"], use_na_sentinel=False)[0], batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero((runs[1:] != runs[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            name = batch["run"].iloc[start]
            own = (None if pd.isna(name) else name, int(blocks[start]))
            if held and own != last:
                yield *last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = own
            held.append(batch.iloc[start:end])
    if held:
        yield *last, pd.concat(held) if len(held) > 1 else held[0]


def _beats(f1, loss, best_f1, best_loss, min_gain: float):
    return (f1 > best_f1 + min_gain) | ((abs(f1 - best_f1) <= min_gain) & (loss < best_loss))


def _next(f1: np.ndarray, loss: np.ndarray, start: int, state: tuple[float, float], min_gain: float) -> int:
    """The first place from ``start`` whose epoch replaces the state, or the length."""
    width = 64
    while start < len(f1):
        hit = np.flatnonzero(_beats(f1[start : start + width], loss[start : start + width], *state, min_gain))
        if len(hit):
            return start + int(hit[0])
        start, width = start + width, width * 4
    return len(f1)


def _chain(f1: np.ndarray, loss: np.ndarray, start: int, state: tuple[float, float] | None, min_gain: float) -> list[int]:
    """Places chosen from ``start`` on; without a state the first one is."""
    places = []
    at = start if state is None else _next(f1, loss, start, state, min_gain)
    while at < len(f1):
        places.append(at)
        at = _next(f1, loss, at + 1, (f1[at], loss[at]), min_gain)
    return places


def _summary(f1: np.ndarray, loss: np.ndarray, min_gain: float) -> list[tuple]:
    """(f1, loss, steps, exit_f1, exit_loss) of the epochs that no earlier one equals or beats in both.

    The sum and the difference of the rule may round apart where an epoch is just the tolerance better: there, it neither
    replaces nor ties. So an epoch is only left out for another F1 if two of them, or one clearly higher, beat it.
    """
    left, records = np.arange(len(f1)), []
    beaten_by = np.full(len(f1), np.nan)
    while len(left):
        i, left = left[0], left[1:]
        records.append(int(i))
        beaten = (f1[left] <= f1[i]) & (loss[left] >= loss[i])
        sure = (f1[left] == f1[i]) | (f1[left] < f1[i] - 3 * min_gain) | (np.abs(beaten_by[left] - f1[i]) > 1e-9 * max(1.0, abs(f1[i])))
        once = left[beaten & np.isnan(beaten_by[left])]
        beaten_by[once] = f1[i]
        left = left[~(beaten & sure)]
    leads: dict[int, tuple[int, int]] = {}  # place -> steps and last place when it is chosen
    out = []
    for place in records:
        path = [place]
        while path[-1] not in leads:
            following = _next(f1, loss, path[-1] + 1, (f1[path[-1]], loss[path[-1]]), min_gain)
            if following == len(f1):
                leads[path[-1]] = (1, path[-1])
            else:
                path.append(following)
        for at, then in zip(path[-2::-1], path[:0:-1], strict=True):
            leads[at] = (leads[then][0] + 1, leads[then][1])
        steps, end = leads[place]
        out.append((float(f1[place]), float(loss[place]), steps, float(f1[end]), float(loss[end])))
    return out


def best_epoch(chain: DataFrame) -> DataFrame:
    return chain.groupBy("run").agg(
        F.max_by(F.struct("epoch", "f1", "loss"), "step").alias("b"), F.max("epochs").alias("epochs")
    ).select("run", F.col("b.epoch").alias("best_epoch"), F.col("b.f1").alias("best_f1"), F.col("b.loss").alias("best_loss"), "epochs")


def early_stop(chain: DataFrame, patience: int) -> DataFrame:
    """Epochs a run really gets: it stops after ``patience`` epochs in a row without an improvement."""
    numbered = chain.select("run", "step", "position", "epoch", "f1", "loss", "epochs")
    following = chain.select("run", (F.col("step") - 1).alias("step"), F.col("position").alias("next_position"))
    gaps = numbered.join(following, ["run", "step"], "left").withColumn(
        "stop", F.when(F.coalesce("next_position", F.col("epochs") + 1) - F.col("position") > patience, F.col("position") + patience)
    )
    stops = gaps.groupBy("run").agg(F.min("stop").alias("stop"), F.max("epochs").alias("epochs"))
    return (
        numbered.drop("epochs").join(stops, "run")
        .filter(F.col("stop").isNull() | (F.col("position") <= F.col("stop")))
        .groupBy("run")
        .agg(
            F.max_by("epoch", "step").alias("best_epoch"),
            F.max_by("f1", "step").alias("best_f1"),
            F.max(F.coalesce("stop", "epochs")).alias("effective_epochs"),
            F.max(F.col("stop").isNotNull()).alias("stopped_early"),
        )
    )


def history_totals(history: DataFrame) -> DataFrame:
    """Training minutes, peak memory and epochs per run."""
    return history.groupBy("run").agg(
        (F.sum("elapsed_seconds") / 60.0).alias("training_minutes"),
        F.max("peak_memory_mb").alias("peak_memory_mb"),
        F.count("*").alias("epochs_completed"),
        F.max("epoch").alias("last_epoch"),
    )


def best_and_last(history: DataFrame, metric: str = "f1") -> DataFrame:
    """Best row by a metric (the earliest among equals) and the last row of each run."""
    return history.groupBy("run").agg(
        F.max_by(F.struct("epoch", "f1", "loss"), F.struct(F.col(metric), -F.col("epoch"))).alias("best"),
        F.max_by(F.struct("epoch", "f1", "loss"), "epoch").alias("last"),
    ).select(
        "run",
        F.col("best.epoch").alias("best_epoch"),
        F.col("best.f1").alias("best_f1"),
        F.col("best.loss").alias("best_loss"),
        F.col("last.epoch").alias("epochs_completed"),
        F.col("last.f1").alias("final_f1"),
        F.col("last.loss").alias("final_loss"),
    )


def metric_curves(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Long (run, epoch, metric, value) series."""
    series = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return history.select("run", "epoch", F.explode(series).alias("s")).select("run", "epoch", "s.metric", "s.value")


# --- run tables ----------------------------------------------------------------------------


def assemble_runs(config: DataFrame, totals: DataFrame, summary: DataFrame) -> DataFrame:
    return config.join(totals, "run").join(summary, "run")


def missing_parts(expected: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(run, part) of every expected run that lacks a config, a history or a summary."""
    return reduce(
        DataFrame.unionByName,
        [
            expected.select("run").join(df.select("run").distinct(), "run", "left_anti").withColumn("part", F.lit(name))
            for name, df in parts.items()
        ],
    )


def comparison_table(runs: DataFrame) -> DataFrame:
    """Model comparison with derived size, error and time columns."""
    parameters = F.coalesce("total_parameters", "trainable_parameters")
    return runs.select(
        "run",
        parameters.alias("parameters"),
        (parameters / 1e6).alias("parameters_million"),
        (parameters * 4.0 / 1024.0**2).alias("fp32_size_mb"),
        "epochs_completed",
        "training_minutes",
        "test_accuracy",
        "test_macro_f1",
        "test_examples",
        flags.fallback_errors(F.col("errors"), F.col("test_errors"), F.col("test_accuracy"), F.col("test_examples")).alias("errors"),
    )


def different_sizes(runs: DataFrame, expected: int | None = None) -> DataFrame:
    """Runs whose test set has another size than expected, or than the smallest one seen."""
    if expected is not None:
        return runs.filter(F.col("test_examples") != expected)
    reference = runs.agg(F.min("test_examples").alias("n"))
    return runs.select("*", reference.scalar().alias("_n")).filter(F.col("test_examples") != F.col("_n")).drop("_n")


def winner_and_reduction(comparison: DataFrame, larger: str, smaller: str) -> DataFrame:
    """Best run by macro-F1 and the parameter saving of one named run against another."""
    def parameters_of(name):
        return F.max(F.when(F.col("run") == name, F.col("parameters")))

    return comparison.agg(
        F.min_by("run", F.struct(-F.col("test_macro_f1"), F.col("run"))).alias("winner"),
        F.max("test_macro_f1").alias("winner_macro_f1"),
        (1.0 - parameters_of(smaller) / parameters_of(larger)).alias("parameter_reduction"),
    )


def seed_stability(runs: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, extremes and range (percentage points) per metric over repeated runs."""
    series = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (
        runs.select(*(keys or []), F.explode(series).alias("s"))
        .groupBy(*(keys or []), F.col("s.metric").alias("metric"))
        .agg(
            F.count("s.value").alias("runs"),
            F.avg("s.value").alias("mean"),
            F.stddev_samp("s.value").alias("std"),
            F.min("s.value").alias("min"),
            F.max("s.value").alias("max"),
            ((F.max("s.value") - F.min("s.value")) * 100.0).alias("range_pp"),
        )
    )


def at_best_epoch(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """History rows of the chosen epoch, with the number of matches per run (must be 1)."""
    picked = chosen.select("run", F.col("best_epoch").alias("epoch"))
    counted = history.join(picked, ["run", "epoch"]).groupBy("run").agg(F.count("*").alias("n"))
    return picked.join(history, ["run", "epoch"], "left").join(counted, "run", "left").withColumn("matches", F.coalesce("n", F.lit(0))).drop("n")


def generalization_gap(at_best: DataFrame, test: DataFrame) -> DataFrame:
    """Differences between augmented train, clean train, validation and test at the best epoch."""
    def gap_pp(a, b):
        return (F.col(a) - F.col(b)) * 100.0

    return at_best.join(test, "run").select(
        "run",
        F.col("epoch").alias("best_epoch"),
        "train_accuracy",
        "train_eval_accuracy",
        "validation_accuracy",
        "test_accuracy",
        gap_pp("train_eval_accuracy", "validation_accuracy").alias("clean_train_minus_validation_pp"),
        gap_pp("validation_accuracy", "test_accuracy").alias("validation_minus_test_pp"),
        (F.col("train_eval_macro_f1") - F.col("validation_macro_f1")).alias("clean_train_minus_validation_macro_f1"),
        (F.col("validation_macro_f1") - F.col("test_macro_f1")).alias("validation_minus_test_macro_f1"),
    )


# --- examples ------------------------------------------------------------------------------


def most_confident(predicted: DataFrame, correct: bool, limit: int) -> DataFrame:
    wanted = F.col("correct") if correct else ~F.col("correct")
    return predicted.filter(wanted).orderBy(F.desc("confidence"), "id").limit(limit)


def diverse_examples(predicted: DataFrame, limit: int, correct: bool) -> DataFrame:
    """First record of every class (or of every wrong class pair) in id order, topped up in id order.

    The firsts are found by a minimum per key, so no key is ever sorted as a whole.
    """
    wanted = predicted.filter(F.col("correct") if correct else ~F.col("correct"))
    keys = ["true_index"] if correct else ["true_index", "predicted_index"]
    firsts = wanted.groupBy(*keys).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first_of_kind"))
    return (
        wanted.join(firsts, "id", "left")
        .withColumn("first_of_kind", F.coalesce("first_of_kind", F.lit(False)))
        .orderBy(F.desc("first_of_kind"), "id")
        .limit(limit)
    )
