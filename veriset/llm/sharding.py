"""Global shuffle into shards in two external passes.

Pass one scatters records uniformly into buckets that fit a task's memory, by a seeded hash, and writes them. Pass two
gathers each bucket, puts it through a Fisher-Yates shuffle (the method behind Spark's ``shuffle``) and deals the result
out: the place of a record is its bucket's offset plus its rank within the bucket, shards take places in turn.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriset.session import materialise

SEED = 90217
#: Bytes of a bucket; a task holds a few copies of one bucket.
BUCKET_BYTES = 32 * 2**20
#: Bytes that a record counts besides its text.
ROW_BYTES = 64
#: Offsets of up to so many buckets (16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_BUCKETS = 500_000

OWN = ("bucket", "position", "shard", "slot")


def bucket_offsets(scattered: DataFrame, block: int = 1024) -> DataFrame:
    """(bucket, offset): rows in the buckets before; sums of blocks first, so that no task sees all buckets."""
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bucket") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, "block").select("bucket", (F.col("start") + F.col("inner")).alias("offset"))


def shuffle_to_shards(df: DataFrame, shards: int = 16, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of ``df`` in random order with bucket, position (from 0), shard and slot (gapless from 0 in each shard).

    Shards differ by one row at most. Every row takes part: null texts and keys, repeated rows and ties are rows like any
    other and are scattered apart, because the hash takes a row number written by pass one. An empty table gives an
    empty result. Input columns named like an added one are replaced. The largest record must fit a task.
    """
    kept = [c for c in df.columns if c not in OWN]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)) + F.lit(ROW_BYTES)
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in kept])
    # A task's output is committed once, so a row has one number and one bucket, also after retries.
    scattered = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("__row")), F.lit(buckets))))
    offsets = bucket_offsets(scattered.select("bucket"))
    gathered = (
        scattered.repartition(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("__row", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]))).alias("records"))
        .join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "bucket")
        .withColumn("records", F.shuffle("records", F.lit(seed)))
    )
    dealt = gathered.select("bucket", "offset", F.posexplode("records").alias("rank", "record"))
    place = F.col("offset") + F.col("rank")
    return dealt.select(
        *[F.col(f"record.c{i}").alias(c) for i, c in enumerate(kept)],
        "bucket",
        place.alias("position"),
        (place % shards).cast("int").alias("shard"),
        F.floor(place / shards).cast("bigint").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; files hold ascending slots, so a reader that takes files by first slot streams the order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
