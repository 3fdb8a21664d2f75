"""Ranks and running sums that never put one whole key into one task.

A plain window over a key sorts all rows of that key in a single task. Here the rows of a key are cut
into ordered blocks, the blocks are summed, and each row adds the total of the earlier blocks of its
key to its running sum inside the block. Only the small block table is windowed per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriset.functions.names import hash60
from veriset.session import materialise

HASH_BITS = 60


def hash_block(hash_value: Column, bits: int = 10) -> Column:
    """Ordered block of a 60-bit hash: its leading bits, so blocks of any key are equally full."""
    return F.shiftright(hash_value, HASH_BITS - bits)


def block_bits(df: DataFrame, rows: int = 100_000) -> int:
    """Bits for blocks of about ``rows`` rows, were all rows under one key."""
    return max(4, math.ceil(math.log2(max(1, df.count() / rows))))


def _as_columns(items: list[str | Column]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    values: dict[str, Column],
    block: Column | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, per ``keys`` in ``order``, the sum of each value over all *earlier* rows.

    ``block`` names a monotone function of the order that is known beforehand (``hash_block``).
    Without it the rows are range-partitioned, which Spark balances by sampling, and written once so
    that the block boundaries stay fixed. ``order`` should be unique per key. ``following`` adds the
    value of the next row (null on the last row of a key).
    """
    following = following or {}
    order_columns = _as_columns(order)
    if block is None:
        placed = df.repartitionByRange(*[F.col(k) for k in keys], *order_columns)
        blocked = materialise(placed.withColumn("_block", F.spark_partition_id()))
    else:
        blocked = df.withColumn("_block", block)
    rows = blocked.select(
        "*",
        *[value.alias(f"_v_{name}") for name, value in values.items()],
        *[value.alias(f"_n_{name}") for name, value in following.items()],
    )

    first_of_block = [
        F.min_by(F.struct(F.col(f"_n_{name}").alias("v")), F.struct(*order_columns)).alias(f"_f_{name}")
        for name in following
    ]
    totals = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values], *first_of_block
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_k_block"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in values],
        *[F.lead(f"_f_{name}").over(by_block).alias(f"_l_{name}") for name in following],
    )

    inside = Window.partitionBy(*keys, "_block").orderBy(*order_columns)
    inside_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[F.coalesce(F.sum(f"_v_{name}").over(inside_before), F.lit(0)).alias(f"_s_{name}") for name in values],
        *[F.lead(F.struct(F.col(f"_n_{name}").alias("v"))).over(inside).alias(f"_m_{name}") for name in following],
    )
    same_block = F.col("_block") == F.col("_k_block")
    for key in keys:
        same_block = same_block & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    kept = [c for c in df.columns if c not in values and c not in following]
    return local.join(offsets, same_block).select(
        *kept,
        *[(F.col(f"_s_{name}") + F.col(f"_o_{name}")).alias(name) for name in values],
        *[F.coalesce(F.col(f"_m_{name}"), F.col(f"_l_{name}"))["v"].alias(name) for name in following],
    )


def rank_rows(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank", block: Column | None = None) -> DataFrame:
    """1-based row number per key without a window over the whole key."""
    ranked = running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, block=block)
    return ranked.withColumn(name, F.col(name) + 1)


def rank_by_hash(df: DataFrame, keys: list[str], salt: str, id_column: str = "id", name: str = "rank", bits: int | None = None) -> DataFrame:
    """Reproducible shuffle: 1-based position of each row of a key in the order of its salted hash."""
    hashed = df.withColumn("_hash", hash60(F.lit(f"{salt}:"), F.col(id_column)))
    ranked = rank_rows(hashed, keys, ["_hash", id_column], name, block=hash_block(F.col("_hash"), block_bits(df) if bits is None else bits))
    return ranked.drop("_hash")
