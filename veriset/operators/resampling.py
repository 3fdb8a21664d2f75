"""Bootstrap confidence intervals of metrics that depend on the confusion cells only.

A resample of all records is one draw of counts for the cells, so records are never repeated. The draws come from hashes of
the replicate and the cell, so they can be repeated in any engine and do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.operators import confusion
from veriset.session import materialise

#: Levels of the splitting tree that one task draws at a time.
DEPTH = 10
#: Replicates of a node that one task draws.
CHUNK = 128
#: Hash values: 15 hexadecimal digits.
_RANGE = float(1 << 60)


def uniform(text: str) -> float:
    """A number between 0 and 1 from the first 15 digits of a text's MD5."""
    return (int(hashlib.md5(text.encode()).hexdigest()[:15], 16) + 0.5) / _RANGE


def _window(mean: float, deviation: float, most: float) -> tuple[int, int]:
    """Counts that can be drawn at all: what lies outside is less likely than the smallest hash."""
    spread = 12 * deviation + 40
    return max(0, math.floor(mean - spread)), int(min(most, math.ceil(mean + spread)))


def binomial_counts(n: int, share: float, uniforms: np.ndarray) -> np.ndarray:
    """Binomial counts at some uniforms: how many distribution values lie below each."""
    if n == 0 or share <= 0:
        return np.zeros(len(uniforms), np.int64)
    if share >= 1:
        return np.full(len(uniforms), n, np.int64)
    low, high = _window(n * share, math.sqrt(n * share * (1 - share)), n)
    k = np.arange(low + 1, high + 1, dtype=float)
    return low + _drawn(np.log((n - k + 1) / k) + math.log(share / (1 - share)), uniforms)


def poisson_counts(mean: float, uniforms: np.ndarray) -> np.ndarray:
    """Poisson counts at some uniforms."""
    if mean <= 0:
        return np.zeros(len(uniforms), np.int64)
    low, high = _window(mean, math.sqrt(mean), math.inf)
    return low + _drawn(math.log(mean) - np.log(np.arange(low + 1, high + 1, dtype=float)), uniforms)


def _drawn(steps: np.ndarray, uniforms: np.ndarray) -> np.ndarray:
    """Places in a distribution given by the logarithms of the ratios of neighbouring probabilities."""
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    below = np.cumsum(weights) / weights.sum()
    return np.minimum(np.searchsorted(below, uniforms, side="left"), len(below) - 1)


def split_counts(totals: np.ndarray, weights: np.ndarray, replicates: np.ndarray, depth: int, first: int, seed: int) -> np.ndarray:
    """Counts (replicate, child) of a node's ``len(weights)`` descendants, a power of two, halving level by level.

    ``totals`` are the node's counts; its children are ``depth`` levels from the root and the first of them is ``first``.
    """
    levels = [weights]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    counts = totals[:, None]
    for up, level in enumerate(reversed(levels[:-1]), depth - len(levels) + 1):
        both = level.reshape(-1, 2)
        left = np.zeros_like(counts)
        for node in np.flatnonzero(both.sum(axis=1)):
            name = (first >> (depth - up)) + int(node)
            draws = np.array([uniform(f"{seed}:{r}:{up}:{name}") for r in replicates.tolist()])
            share = both[node, 0] / both[node].sum()
            for n in np.unique(counts[:, node]):
                rows = np.flatnonzero(counts[:, node] == n)
                left[rows, node] = binomial_counts(int(n), float(share), draws[rows])
        counts = np.stack([left, counts - left], axis=2).reshape(len(counts), -1)
    return counts


def multinomial_cells(cells: DataFrame, labels: int, samples: int = 1000, seed: int = 7, model: str = "model") -> DataFrame:
    """(model, replicate, true_index, predicted_index, count): the cells of ``samples`` resamples of all records.

    One multinomial draw over the cells is split from the top: a node's count goes to its two halves by a binomial draw.
    ``DEPTH`` levels are drawn per pass, for each node and replicate on its own, so neither the cells of a model nor its
    replicates have to meet in a task.
    """
    bits = max(1, (labels * labels - 1).bit_length())
    place = F.col("true_index").cast("bigint") * labels + F.col("predicted_index")
    leaves = materialise(cells.select(F.col(model).alias("model"), place.alias("node"), F.col("count").alias("weight")))
    kind = leaves.schema["model"].dataType.simpleString()
    roots = leaves.groupBy("model").agg(F.sum("weight").alias("count"))
    drawn = roots.select("model", F.lit(0).cast("bigint").alias("node"), "count", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    depth = 0
    while depth < bits:
        step = min(DEPTH, bits - depth)
        below = leaves.groupBy("model", F.shiftright("node", bits - depth - step).alias("child")).agg(F.sum("weight").alias("weight"))
        # at most 2 ** DEPTH children of a node
        listed = below.groupBy("model", F.shiftright("child", step).alias("node")).agg(F.collect_list(F.struct("child", "weight")).alias("children"))
        drawn = _split(drawn, listed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((samples - 1) // CHUNK).cast("bigint")))), kind, depth + step, step, seed)
        depth += step
    found = drawn.withColumnsRenamed({"model": model})
    return found.select(model, "replicate", F.expr(f"cast(node div {labels} as int)").alias("true_index"), (F.col("node") % labels).cast("int").alias("predicted_index"), "count")


def _split(nodes: DataFrame, listed: DataFrame, kind: str, depth: int, step: int, seed: int) -> DataFrame:
    """Counts of the children of every (model, node, replicate) row; a task draws one node for ``CHUNK`` replicates."""
    names = ["model", "node", "count", "replicate"]

    def draw(rows: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or children.empty:
            return pd.DataFrame(columns=names)
        first = int(rows["node"].iloc[0]) << step
        weights = np.zeros(1 << step, np.int64)
        for child in children["children"].iloc[0]:
            weights[child["child"] - first] = child["weight"]
        replicates = rows["replicate"].to_numpy()
        counts = split_counts(rows["count"].to_numpy(), weights, replicates, depth, first, seed)
        r, c = np.nonzero(counts)
        return pd.DataFrame({"model": [rows["model"].iloc[0]] * len(r), "node": first + c, "count": counts[r, c], "replicate": replicates[r]})

    key = ["model", "node", "chunk"]
    left = nodes.withColumn("chunk", F.expr(f"replicate div {CHUNK}"))
    return left.groupBy(*key).cogroup(listed.groupBy(*key)).applyInPandas(draw, f"model {kind}, node bigint, count bigint, replicate int")


def multinomial_replicates(cells: DataFrame, labels: int, samples: int = 1000, seed: int = 7, model: str = "model") -> DataFrame:
    """(model, replicate, accuracy, macro_f1) of ``samples`` resamples of all records."""
    return _quality(multinomial_cells(cells, labels, samples, seed, model), labels, [model, "replicate"])


def poisson_cells(predicted: DataFrame, samples: int, keys: list[str] | None = None, salt: str = "poisson") -> DataFrame:
    """Confusion cells per replicate where each record counts Poisson(1) times.

    The records of a cell count Poisson(their number) times together, so one draw per cell and replicate is enough.
    """
    keys = keys or []
    cells = predicted.groupBy(*keys, "true_index", "predicted_index").agg(F.count("*").alias("records"))
    spread = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = spread.withColumn("count", _poisson(salt)(F.col("records"), F.col("replicate"), F.col("true_index"), F.col("predicted_index")))
    return drawn.filter("count > 0").select(*keys, "replicate", "true_index", "predicted_index", "count")


def _poisson(salt: str):
    @F.pandas_udf("bigint")
    def draw(records: pd.Series, replicate: pd.Series, true_index: pd.Series, predicted_index: pd.Series) -> pd.Series:
        uniforms = np.array([uniform(f"{salt}:{r}:{t}:{p}") for r, t, p in zip(replicate, true_index, predicted_index, strict=True)])
        counts = np.zeros(len(records), np.int64)
        for mean in records.unique():
            rows = np.flatnonzero(records.to_numpy() == mean)
            counts[rows] = poisson_counts(float(mean), uniforms[rows])
        return pd.Series(counts)

    return draw


def poisson_replicates(predicted: DataFrame, labels: int, samples: int, keys: list[str] | None = None) -> DataFrame:
    return _quality(poisson_cells(predicted, samples, keys), labels, [*(keys or []), "replicate"])


def _quality(counted: DataFrame, labels: int, by: list[str]) -> DataFrame:
    return confusion.averages(confusion.class_report(counted, labels, by), by).select(*by, "accuracy", "macro_f1")


def intervals(replicates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles over the replicates."""
    aggregates = [F.count("*").alias("samples")]
    for name in ("accuracy", "macro_f1"):
        aggregates += [
            F.avg(name).alias(f"{name}_mean"),
            F.percentile(name, F.lit(0.025)).alias(f"{name}_ci_low"),
            F.percentile(name, F.lit(0.975)).alias(f"{name}_ci_high"),
        ]
    return replicates.groupBy(*(keys or [])).agg(*aggregates)
