"""Near-duplicates by SimHash with the pigeonring filter.

A fingerprint of 64 bits is cut into a ring of m segments. If two fingerprints differ in at most t bits, then some
segment starts a chain of which every prefix of l segments differs in at most l * t / m bits. Candidates must have such
a chain: its exact start (the prefixes whose budget is below one bit) is the join key, the later prefixes are compared
before the full distance. Fingerprints that crowd under one key are linked through shared one-bit variants instead, which
gives the same components without listing pairs.

That holds for small distances (``near_duplicates``). For a similarity (``keep_one``) the distance is a fifth of the bits, and
no chain start is exact for long enough to be a key: there the candidates share a smallest shingle under one of several hash
orders, and the chains prune them before the full distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriset.llm.common import attach, groups_of, texts_of
from veriset.llm.components import components
from veriset.session import materialise

BITS = 64
SEGMENTS = 16
SHINGLE = 3
DISTANCE = 2
SEED = 42
#: A key with more fingerprints is linked through variants; both ways are exact.
CROWD = 128
_BLOCK = 1 << 15
#: Similarity is 1 - distance / 64. Two texts that share a share s of their shingles agree on a smallest shingle under at
#: least one of the orders with probability 1 - (1 - s) ** ORDERS, which is 0.9999 at 0.8.
SIMILARITY = 0.8
ORDERS = 6
#: Rows of a block of candidates; blocks of one key are compared pair by pair of blocks, each in its own task.
CANDIDATES = 1024


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the space-joined shingles, in blocks, so that a long text takes no more memory than its words."""
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    for start in range(0, last, _BLOCK):
        part = words[start : min(last, start + _BLOCK) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        heads = np.concatenate(([0], ends[:-1] + 1))
        span = min(shingle, len(part))
        pairs = zip(heads[: len(part) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(part) - span + 1)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def sketch(text: str, shingle: int = SHINGLE, orders: int = 0) -> tuple[int, list[int]]:
    """The 64-bit fingerprint of a text, as a signed number, and its smallest shingle under each of some hash orders."""
    words = text.encode().lower().split()
    if not words:
        return 0, []
    counts, total, least = np.zeros(BITS, np.int64), 0, None
    for block in _hashes(words, shingle):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
        if orders:
            mixed = np.array([((block ^ (block >> np.uint64(29))) * f).min() for f in _FACTORS[:orders]])
            least = mixed if least is None else np.minimum(least, mixed)
    packed = np.packbits(counts * 2 > total, bitorder="little").view(np.int64)
    return int(packed[0]), least.view(np.int64).tolist() if orders else []


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return sketch(text, shingle)[0]


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, orders: int = 0) -> DataFrame:
    """Rows of ``df`` with ``fp`` (long), and ``anchors`` if orders are asked for. Null and empty texts have fingerprint zero."""
    fields = [T.StructField("fp", T.LongType(), False), T.StructField("anchors", T.ArrayType(T.LongType(), False), False)]

    def compute(column: pa.Array) -> list[pa.Array]:
        found = [sketch(value, shingle, orders) for value in texts_of(column)]
        columns = [pa.array([f for f, _ in found], pa.int64()), pa.array([a for _, a in found], pa.list_(pa.int64()))]
        return columns if orders else columns[:1]

    return attach(df, text, fields if orders else fields[:1], compute)


def turned(fp: Column, bits: int) -> Column:
    """The fingerprint with its ring turned by some bits."""
    return fp if bits == 0 else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, BITS - bits))


def chain_budgets(distance: int, segments: int) -> list[int]:
    """Most differing bits of the first l segments of a chain, for l from 1."""
    return [distance * length // segments for length in range(1, segments + 1)]


def _mask(bits: int) -> int:
    value = (1 << bits) - 1
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b) links that connect distinct fingerprints (column ``fp``) at ``distance`` bits or fewer.

    Each pair within the distance is linked directly, or, under a crowded key, through fingerprints at that distance.
    """
    if BITS % segments or distance >= segments or distance > 2:
        raise ValueError("segments must divide 64 and exceed the distance, which is at most 2")
    width, budgets = BITS // segments, chain_budgets(distance, segments)
    exact = next(i for i, budget in enumerate(budgets) if budget) if distance else segments
    starts = F.array(*[turned(F.col("fp"), i * width) for i in range(segments)])
    rows = fps.select(F.posexplode(starts).alias("seg", "ring")).withColumn("key", F.col("ring").bitwiseAND(F.lit(_mask(exact * width)).cast("bigint")))
    rows = materialise(rows)
    size = rows.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = materialise(rows.join(size, ["seg", "key"]))

    sparse = marked.where(F.col("n") <= crowd).select("seg", "key", "ring")
    left, right = sparse.alias("l"), sparse.alias("r")
    differing = F.col("l.ring").bitwiseXOR(F.col("r.ring"))
    chain = F.lit(True)
    for length in range(exact + 1, segments + 1):
        # Prefixes of one budget are covered by the longest of them.
        if length == segments or budgets[length] != budgets[length - 1]:
            chain = chain & (F.bit_count(differing.bitwiseAND(F.lit(_mask(length * width)).cast("bigint"))) <= budgets[length - 1])
    pairs = left.join(right, (F.col("l.seg") == F.col("r.seg")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.ring") < F.col("r.ring")) & chain)
    listed = pairs.select(F.col("l.seg").alias("seg"), F.col("l.ring").alias("a"), F.col("r.ring").alias("b"))

    # Two rings under one key are within two bits if and only if they share one of their one-bit variants.
    crowded = marked.where(F.col("n") > crowd).select("seg", "ring")
    bits = range(exact * width, BITS) if distance else ()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << bit)).cast("bigint") for bit in bits])
    variants = crowded.select("seg", "ring", F.explode(F.transform(flips, lambda f: F.col("ring").bitwiseXOR(f))).alias("variant"))
    if distance == 1:
        # A pair at one bit is a fingerprint and a variant of it.
        stars = variants.alias("v").join(crowded.alias("c"), (F.col("v.seg") == F.col("c.seg")) & (F.col("v.variant") == F.col("c.ring")) & (F.col("v.ring") < F.col("c.ring")))
        linked = stars.select(F.col("v.seg").alias("seg"), F.col("v.ring").alias("a"), F.col("c.ring").alias("b"))
    else:
        variants = materialise(variants)
        centres = variants.groupBy("seg", "variant").agg(F.min("ring").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        linked = variants.join(centres, ["seg", "variant"]).where("ring <> least").select("seg", F.col("least").alias("a"), F.col("ring").alias("b"))
    both = listed.union(linked) if distance else listed

    def straight(name: str) -> Column:
        back = F.col(name)
        for i in range(1, segments):
            back = F.when(F.col("seg") == i, turned(F.col(name), BITS - i * width)).otherwise(back)
        return back

    return both.select(straight("a").alias("a"), straight("b").alias("b")).distinct()


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(key, fp, root, component_id): one row for each row of ``df``.

    component_id is the smallest key among the rows whose fingerprints reach each other; nulls count only where a
    component has no other key. Equal texts, repeated rows and all texts without words (fingerprint zero) share a
    fingerprint and so a component. Whole texts are read; other columns are not needed and may have any name.
    """
    rows = materialise(with_fingerprints(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__body")), "__body", shingle).select("__key", "fp"))
    found = roots(rows, distance, segments)
    return found.select(F.col("__key").alias(key), "fp", "root", "component_id")


def roots(rows: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(__key, fp) rows with their component's root and least key."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("__key").alias("least")))
    return _rooted(rows, distinct, fingerprint_links(distinct.select("fp"), distance, segments))


def _rooted(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    reached = components(links)
    classes = distinct.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("__fp")).select("__key", "fp", "root", "component_id")


_NIBBLE = np.array([bin(i).count("1") for i in range(16)], np.uint8)


def chained(differing: np.ndarray, distance: int) -> np.ndarray:
    """Which of some XORs hold a chain of 4-bit segments whose prefixes all keep within their budgets."""
    raw = differing.view(np.uint8).reshape(-1, 8)
    ring = np.empty((len(raw), 2 * SEGMENTS), np.uint8)
    ring[:, 0:SEGMENTS:2], ring[:, 1:SEGMENTS:2] = _NIBBLE[raw & 15], _NIBBLE[raw >> 4]
    ring[:, SEGMENTS:] = ring[:, :SEGMENTS]
    sums = np.concatenate([np.zeros((len(raw), 1), np.int16), np.cumsum(ring, axis=1, dtype=np.int16)], axis=1)
    budgets = np.array(chain_budgets(distance, SEGMENTS), np.int16)
    found = np.zeros(len(raw), bool)
    for start in range(SEGMENTS):
        open_ = np.flatnonzero(~found)
        if len(open_):
            found[open_] = (sums[open_, start + 1 : start + SEGMENTS + 1] - sums[open_, start : start + 1] <= budgets).all(axis=1)
    return found


def similar_links(anchored: DataFrame, distance: int) -> DataFrame:
    """(a, b) links that connect fingerprints within ``distance`` bits among those that share an anchor.

    ``anchored`` is (anchor, fp). A key with many fingerprints is cut into blocks; every pair of its blocks is compared in a
    task of its own, which holds two blocks and gives the links of a spanning forest only, not all pairs.
    """
    rows = materialise(anchored.distinct())
    sizes = rows.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = rows.join(sizes, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    spread = placed.select("anchor", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("anchor", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for group in groups_of(batches, 3):
            x, own, fps = (np.asarray(group.column(c)) for c in ("x", "own", "fp"))
            left, right = fps[own == x], fps[own != x]
            right = right if len(right) else left
            root = {int(f): int(f) for f in fps}

            def find(f: int, root=root) -> int:
                while root[f] != f:
                    root[f] = root[root[f]]
                    f = root[f]
                return f

            for start in range(0, len(left), 64):
                part = left[start : start + 64]
                differing = (part[:, None] ^ right[None]).ravel()
                candidates = np.flatnonzero((differing != 0))
                candidates = candidates[chained(differing[candidates], distance)]
                near = candidates[np.bitwise_count(differing[candidates].view(np.uint64)) <= distance]
                for i, j in zip((near // len(right)).tolist(), (near % len(right)).tolist(), strict=True):
                    a, b = int(part[i]), int(right[j])
                    ra, rb = find(a), find(b)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        held.append((a, b))
            if len(held) > 10_000:
                yield pair_batch(held)
                held = []
        if held:
            yield pair_batch(held)

    dealt = cells.repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y").select("anchor", "x", "y", "own", "fp")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` with one row of each component: that of the smallest key, of equal ones the first in the table.

    Fingerprints link at a similarity of 1 - distance / 64 or more if their texts share an anchor; equal texts and all texts
    without words share a fingerprint. Null keys come last. Columns are unchanged, whatever their names.
    """
    distance = math.floor(BITS * (1 - similarity) + 1e-9)
    kept = list(df.columns)
    numbered = df.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    at = {c: f"c{i}" for i, c in enumerate(kept)}
    # Written once, so that a row keeps its number; the search reads the small columns of it.
    stored = materialise(with_fingerprints(numbered.withColumn("__body", F.col(at[text])), "__body", shingle, ORDERS).drop("__text", "__body"))
    rows = stored.select(F.col("__row").alias("__key"), "fp")
    distinct = materialise(rows.groupBy("fp").agg(F.min("__key").alias("least")))
    anchored = stored.select("fp", F.posexplode("anchors").alias("order", "least")).select(F.xxhash64("order", "least").alias("anchor"), "fp")
    found = _rooted(rows, distinct, similar_links(anchored, distance)).select(F.col("__key").alias("row"), "root")
    ordered = F.struct(F.col(at[key]).isNull().alias("last"), F.col(at[key]).alias("key"), F.col("__row").alias("row"))
    heads = stored.select("__row", ordered.alias("place")).join(found, F.col("__row") == F.col("row")).groupBy("root").agg(F.min("place").alias("first"))
    winners = heads.select(F.col("first.row").alias("__winner"))
    return stored.join(winners, F.col("__row") == F.col("__winner"), "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])
