"""Mixing sources to target weights by Poisson replication.

Each document is repeated Poisson(rate of its source) times. The draw inverts the distribution at a uniform number
hashed from a seed and the document, so it needs no state, is the same on every retry, and can be recomputed elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 2027
#: Rates above this bound are cut into equal parts that are drawn apart and added, which keeps exp(-rate) normal.
PART = 16.0


def uniform(seed: Column, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", seed, *keys)), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def steps(rate: float) -> int:
    """Terms after which the rest of the distribution is below the resolution of the uniform number."""
    return math.ceil(rate + 12 * math.sqrt(rate) + 24)


def poisson(u: Column, rate: Column, terms: int = steps(PART)) -> Column:
    """The least k with P(X <= k) >= u; rate at most PART."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def grow(acc, i):
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.when(acc["c"] < u, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, grow, lambda acc: acc["k"])


def replication_rates(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", total: float | None = None) -> DataFrame:
    """(source, rows, weight, rate): the mean number of repetitions that brings each source to its share.

    ``weights`` are shares of the result in rows, of any sum; a source that is not listed gets none. Without weights
    each source counts with the square root of its rows. ``total`` is the wanted number of rows, the input's when null.
    """
    size = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighed = size.withColumn("weight", F.sqrt("rows"))
    else:
        listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        share = F.lit(None).cast("double") if listed is None else F.try_element_at(listed, F.col("source"))
        weighed = size.withColumn("weight", F.coalesce(share.cast("double"), F.lit(0.0)))
    sums = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    target = float(sums[1] if total is None else total)
    rate = F.col("weight") / F.lit(float(sums[0])) * F.lit(target) / F.col("rows") if sums[0] > 0 else F.lit(0.0)
    return weighed.select("source", "rows", "weight", rate.alias("rate"))


def poisson_mix(
    df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", seed: int = SEED, total: float | None = None, max_rate: float | None = 1024.0
) -> DataFrame:
    """Rows of ``df`` repeated to the target weights and shuffled globally, with ``copy`` (from 1) and ``shuffle_key``.

    A null source is a source of its own (weight only if none are given). A null key is hashed as the empty string;
    rows that share key and source draw the same count. Texts pass through unread. Empty tables give empty results.
    Input columns named copy or shuffle_key are replaced. With a ``total``, ``max_rate`` guards against a rate that
    would flood the result and fails the query when exceeded, rather than cutting it (None: no bound). Without a total the
    result has about as many rows as the input, however large the rate of a small source, and no bound applies.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("copy", "shuffle_key")]
    rates = replication_rates(df, weights, source, total).select(F.col("source").alias("__source"), "rate")
    # A few rows per source name: Spark broadcasts it while its size allows, and splits a hot source otherwise.
    rated = df.select(*kept).join(rates, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    name, document = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    checked = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    if total is not None and max_rate is not None:
        checked = F.when(F.col("rate") <= max_rate, checked).otherwise(F.raise_error(F.lit("a replication rate exceeds max_rate")).cast("int"))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda acc, part: acc + poisson(uniform(F.concat(F.lit(f"{seed}:"), part.cast("string")), name, document), F.col("rate") / F.col("__parts")),
    )
    counted = rated.withColumn("__parts", checked).withColumn("__count", draws).where("__count > 0")
    copies = counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), name, document, F.col("copy").cast("string"))))
    # A uniform hash places each copy; the task number spreads rows that are equal in every column.
    placed = keyed.withColumn("__place", F.xxhash64(F.col("shuffle_key"), F.spark_partition_id()))
    return placed.repartition("__place").sortWithinPartitions("shuffle_key").drop("__place")
