"""Review tables and verdicts over suspicious pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions import flags
from veriset.functions.names import split_pair
from veriset.operators.links import near_node_pairs
from veriset.operators.nearhash import Totals, sorted_groups
from veriset.session import materialise

#: Contents of a side of a tile, and pairs of contents of two nodes up to which they are rows of a batch instead.
TILE, FEW = 1024, 64
#: Pairs that are measured at a time.
STEP = 4096


def content_pairs(node_pairs: DataFrame, records: DataFrame, content: str) -> DataFrame:
    """Node pairs split by distinct ``content`` (what the metrics are computed from), with counts of record pairs.

    Records of one fingerprint can differ in content, so a metric of a pair of contents is exact for all its records.
    ``unmapped_pairs`` counts the record pairs of which a side has no object. Contents of each side join once.
    """
    nodes = records.groupBy("class", "fp", "split", content).agg(F.count("*").alias("copies"), F.count("object").alias("mapped"), F.min("id").alias("first_id"))
    pairs = node_pairs.select("class", "distance", "fp_a", "split_a", "fp_b", "split_b")
    for side in "ab":
        own = nodes.select("class", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "split", content, "copies", "mapped", "first_id")])
        pairs = pairs.join(own, ["class", f"fp_{side}", f"split_{side}"])
    total = F.col("copies_a") * F.col("copies_b")
    return (
        pairs.withColumn("split_pair", split_pair(F.col("split_a"), F.col("split_b")))
        .withColumn("strict", flags.strict_match(F.col("distance")))
        .withColumn("pairs", total)
        .withColumn("unmapped_pairs", total - F.col("mapped_a") * F.col("mapped_b"))
        .withColumn("involves_unmapped", F.col("unmapped_pairs") > 0)
    )


def measured_pairs(described: DataFrame, grid: str = "grid") -> DataFrame:
    """``described`` with cosine, correlation and mean error of its two grids in place of them, a matrix per Arrow batch."""
    held = (f"{grid}_a", f"{grid}_b")
    kept = described.drop(*held)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "embedding_cosine double", "mae double", "correlation double"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1).astype(float) for c in held)
            inner, squares_a, squares_b = ((x * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b)))
            count, sum_a, sum_b = a.shape[1], a.sum(axis=1), b.sum(axis=1)
            norms = np.sqrt(squares_a) * np.sqrt(squares_b)
            cosine = np.divide(inner, norms, out=np.zeros_like(inner), where=norms > 0)
            spread_a, spread_b = count * squares_a - sum_a**2, count * squares_b - sum_b**2
            roots = np.sqrt(np.maximum(spread_a, 0)) * np.sqrt(np.maximum(spread_b, 0))
            correlation = np.divide(count * inner - sum_a * sum_b, roots, out=np.zeros_like(inner), where=(spread_a > 0) & (spread_b > 0))
            level_a, level_b = (x / np.maximum(x.max(axis=1, keepdims=True), 1e-300) for x in (a, b))
            mae = np.abs(level_a - level_b).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_names), *map(pa.array, (cosine, mae, correlation))], names=[*kept_names, "embedding_cosine", "mae", "correlation"])

    kept_names = kept.columns
    return described.mapInArrow(measure, schema)


def same_object_pairs(node_pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many record pairs share their object, counted per object and side."""
    counts = records.filter(F.col("object").isNotNull()).groupBy("class", "fp", "split", "object").agg(F.count("*").alias("n"))
    pairs = node_pairs.select("class", "fp_a", "split_a", "fp_b", "split_b")
    a, b = (counts.select("class", F.col("fp").alias(f"fp_{s}"), F.col("split").alias(f"split_{s}"), "object", F.col("n").alias(f"n_{s}")) for s in "ab")
    both = pairs.join(a, ["class", "fp_a", "split_a"]).join(b, ["class", "fp_b", "split_b", "object"])
    return both.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0).cast("bigint")).alias("mapped_same_object"))


def flagged_pairs(measured: DataFrame) -> DataFrame:
    """Review flags from ``embedding_cosine``, ``correlation`` and ``mae``."""
    pixel = flags.pixel_flag(F.col("correlation"), F.col("mae"))
    embedding = flags.embedding_flag(F.col("embedding_cosine"))
    return (
        measured.withColumn("pixel_flag", pixel)
        .withColumn("embedding_flag", embedding)
        .withColumn("priority", flags.review_priority(F.col("involves_unmapped"), F.col("pixel_flag"), F.col("embedding_flag")))
    )


def split_pair_distribution(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split_pair").agg(F.sum("pairs").alias("pairs"))


def review_summary(flagged: DataFrame, same_object: DataFrame) -> DataFrame:
    """One row of record-pair counts and extremes; the extremes are null when no pair qualifies."""
    unmapped = F.col("involves_unmapped")
    zero = F.lit(0).cast("bigint")

    def total(column, condition=None):
        value = F.col(column) if condition is None else F.when(condition, F.col(column))
        return F.coalesce(F.sum(value), zero)

    counted = flagged.withColumn("mapped_pairs", F.col("pairs") - F.col("unmapped_pairs"))
    rows = counted.unionByName(same_object, allowMissingColumns=True)
    return rows.agg(
        total("pairs").alias("pairs"),
        total("unmapped_pairs").alias("unmapped_pairs"),
        total("mapped_pairs").alias("mapped_pairs"),
        total("mapped_same_object").alias("mapped_same_object"),
        F.max("embedding_cosine").alias("max_cosine"),
        F.max(F.when(unmapped, F.col("embedding_cosine"))).alias("max_cosine_unmapped"),
        F.max(F.when(unmapped, F.col("correlation"))).alias("max_correlation_unmapped"),
        F.min(F.when(unmapped, F.col("mae"))).alias("min_mae_unmapped"),
        total("unmapped_pairs", F.col("embedding_flag")).alias("unmapped_embedding_flags"),
        total("unmapped_pairs", F.col("pixel_flag")).alias("unmapped_pixel_flags"),
    )


_TOTALS = ("pairs", "unmapped_pairs", "unmapped_embedding_flags", "unmapped_pixel_flags")
_EXTREMES = ("max_cosine", "max_cosine_unmapped", "max_correlation_unmapped", "min_mae_unmapped")


_SUMS = ", ".join([*(f"{c} bigint" for c in _TOTALS), *(f"{c} double" for c in _EXTREMES)])


def packed_contents(records: DataFrame, grid: str = "grid") -> DataFrame:
    """(class, fp, split, copies, mapped, packed): distinct contents with their copies, numbers in as few bytes as hold them all."""
    counted = records.filter(F.col("fp").isNotNull()).groupBy("class", "fp", "split", grid).agg(F.count("*").alias("copies"), F.count("object").alias("mapped"))
    rows = counted.select("class", "fp", "split", "copies", "mapped", F.col(grid).cast("array<double>").alias("packed"))
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("packed").schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(5).flatten()).reshape(batch.num_rows, -1)
            whole = ((x >= 0) & (x == np.floor(x))).all(axis=1)
            top = np.where(whole, x.max(axis=1), np.inf)
            kind = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 8))
            found = np.empty(len(x), object)
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                found[at] = [bytes([k]) + r.tobytes() for r in x[at].astype(_KINDS[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found.tolist(), pa.binary())], names=names)

    return materialise(rows.mapInArrow(pack, f"{kinds}, packed binary"))


_KINDS = {1: np.uint8, 2: np.uint16, 8: np.float64}


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    rows = [v.as_py() for v in column]
    kind = np.array([r[0] for r in rows])
    out = None
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        part = np.frombuffer(b"".join([rows[i][1:] for i in at]), _KINDS[k]).reshape(len(at), -1)
        out = np.empty((len(rows), part.shape[1])) if out is None else out
        out[at] = part
    return out


class _PairTotals:
    """Totals and extremes of ``review_summary`` over pairs of packed contents."""

    def __init__(self) -> None:
        self.table, self.totals, self.extremes = None, [0] * len(_TOTALS), [None] * len(_EXTREMES)

    def _read(self, table: pa.Table) -> None:
        self.table, self.x = table, _unpacked(table.column("packed"))
        self.copies, self.mapped = (np.asarray(table.column(c)) for c in ("copies", "mapped"))
        x, squares, sums = self.x, (self.x * self.x).sum(axis=1), self.x.sum(axis=1)
        self.sums, self.norm = sums, np.sqrt(squares)
        self.root = np.sqrt(np.maximum(x.shape[1] * squares - sums**2, 0))
        self.level = x / np.maximum(x.max(axis=1, keepdims=True), 1e-300)

    def _more(self, place: int, value: float) -> None:
        best, pick = self.extremes[place], min if _EXTREMES[place].startswith("min") else max
        self.extremes[place] = float(value) if best is None else pick(best, float(value))

    def add(self, table: pa.Table, i: np.ndarray, j: np.ndarray) -> None:
        if table is not self.table:
            self._read(table)
        for start in range(0, len(i), STEP):
            self._measure(i[start : start + STEP], j[start : start + STEP])

    def _measure(self, i: np.ndarray, j: np.ndarray) -> None:
        pairs = self.copies[i] * self.copies[j]
        unmapped = pairs - self.mapped[i] * self.mapped[j]
        inner = np.einsum("ij,ij->i", self.x[i], self.x[j])
        norms = self.norm[i] * self.norm[j]
        cosine = np.divide(inner, norms, out=np.zeros_like(inner), where=norms > 0)
        self.totals[0] += int(pairs.sum())
        self.totals[1] += int(unmapped.sum())
        self._more(0, cosine.max())
        some = np.flatnonzero(unmapped > 0)  # the rest is asked of these only
        if not len(some):
            return
        i, j, inner, cosine, unmapped = i[some], j[some], inner[some], cosine[some], unmapped[some]
        roots = self.root[i] * self.root[j]
        correlation = np.divide(self.x.shape[1] * inner - self.sums[i] * self.sums[j], roots, out=np.zeros_like(inner), where=roots > 0)
        mae = np.abs(self.level[i] - self.level[j]).mean(axis=1)
        self.totals[2] += int(unmapped[cosine >= flags.REVIEW_COSINE].sum())
        self.totals[3] += int(unmapped[(correlation >= flags.REVIEW_CORRELATION) & (mae <= flags.REVIEW_MAE)].sum())
        for place, value in enumerate((cosine.max(), correlation.max(), mae.min()), 1):
            self._more(place, value)

    def row(self) -> pa.RecordBatch:
        values = [*[pa.array([v], pa.int64()) for v in self.totals], *[pa.array([v], pa.float64()) for v in self.extremes]]
        return pa.RecordBatch.from_arrays(values, names=[*_TOTALS, *_EXTREMES])


class _SameObject:
    """Number of record pairs, from the records of each row."""

    def __init__(self) -> None:
        self.n = 0

    def add(self, table: pa.Table, i: np.ndarray, j: np.ndarray) -> None:
        n = np.asarray(table.column("n"))
        self.n += int((n[i] * n[j]).sum())

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64())], names=["mapped_same_object"])


#: ``review_summary`` of the pairs of ``packed_contents``, added up where ``near_node_pairs`` finds them.
PAIR_TOTALS = Totals(("copies", "mapped", "packed"), _SUMS, _PairTotals)


def same_object_totals(records: DataFrame, threshold: int) -> DataFrame:
    """``same_object_pairs`` of all pairs within ``threshold`` bits, found among the records of each object instead of among all pairs."""
    counts = records.filter(F.col("object").isNotNull() & F.col("class").isNotNull() & F.col("fp").isNotNull()).groupBy("class", "fp", "split", "object").agg(F.count("*").alias("n"))
    shared = counts.groupBy("class", "object").agg(F.min("split").alias("s"), F.max("split").alias("t")).where("s < t").select("class", "object")
    # two hashes side by side are no name, so names are compared whole
    named = materialise(counts.join(shared, ["class", "object"]).select(F.to_json(F.struct("class", "object")).alias("class"), "fp", "split", "n"))
    return near_node_pairs(named, threshold, totals=Totals(("n",), "mapped_same_object bigint", _SameObject)).agg(F.coalesce(F.sum("mapped_same_object"), F.lit(0).cast("bigint")).alias("mapped_same_object"))


def tiled_summary(node_pairs: DataFrame, records: DataFrame, grid: str = "grid", size: int = TILE, few: int = FEW, same_object: DataFrame | None = None) -> DataFrame:
    """``review_summary`` of all pairs of contents, without a row for those of two nodes with many.

    The distinct contents (``grid``, an array of numbers) of the two nodes of a pair meet in tiles of ``size`` x ``size``: a task
    computes cosines, correlations and mean errors as matrices and returns totals and extremes of its tile. A node's contents
    are dealt once per block of the other side. Nodes of few contents, most of all, would be tiles of a number or two: up to
    ``few`` pairs of contents are rows, measured by the batch. Where ``near_node_pairs`` has added pairs up to ``PAIR_TOTALS``
    already, ``node_pairs`` are these totals and ``same_object`` is that of the same pairs.
    """
    if same_object is not None:
        return _summed(node_pairs, same_object)
    contents = records.groupBy("class", "fp", "split", grid).agg(F.count("*").alias("copies"), F.count("object").alias("mapped"))
    contents = materialise(contents.withColumn("own", F.xxhash64(grid)))
    blocks = contents.groupBy("class", "fp", "split").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"), F.count("*").alias("n"))
    pairs = node_pairs.select("class", "distance", "fp_a", "split_a", "fp_b", "split_b")
    for side in "ab":
        pairs = pairs.join(blocks.select("class", F.col("fp").alias(f"fp_{side}"), F.col("split").alias(f"split_{side}"), F.col("blocks").alias(f"blocks_{side}"), F.col("n").alias(f"n_{side}")), ["class", f"fp_{side}", f"split_{side}"])
    every = materialise(pairs.withColumn("pair", F.monotonically_increasing_id()))
    small = F.col("n_a") * F.col("n_b") <= few
    numbered = every.where(~small).drop("n_a", "n_b", "distance")
    flagged = flagged_pairs(measured_pairs(content_pairs(every.where(small), records, grid), grid))
    unmapped = F.col("involves_unmapped")
    batched = flagged.agg(
        F.sum("pairs").alias("pairs"),
        F.sum("unmapped_pairs").alias("unmapped_pairs"),
        F.sum(F.when(F.col("embedding_flag"), F.col("unmapped_pairs"))).alias("unmapped_embedding_flags"),
        F.sum(F.when(F.col("pixel_flag"), F.col("unmapped_pairs"))).alias("unmapped_pixel_flags"),
        F.max("embedding_cosine").alias("max_cosine"),
        F.max(F.when(unmapped, F.col("embedding_cosine"))).alias("max_cosine_unmapped"),
        F.max(F.when(unmapped, F.col("correlation"))).alias("max_correlation_unmapped"),
        F.min(F.when(unmapped, F.col("mae"))).alias("min_mae_unmapped"),
    )

    def dealt(own: str, other: str, place: int) -> DataFrame:
        side = contents.select("class", F.col("fp").alias(f"fp_{own}"), F.col("split").alias(f"split_{own}"), F.col(grid).cast("array<double>").alias("grid"), "copies", "mapped", "own")
        rows = numbered.join(side, ["class", f"fp_{own}", f"split_{own}"])
        block, others = F.pmod("own", F.col(f"blocks_{own}")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1))
        x, y = (block.alias("x"), others.alias("y")) if place == 0 else (others.alias("x"), block.alias("y"))
        return rows.select("pair", x, y, F.lit(0).alias("z"), F.lit(place).alias("side"), "grid", "copies", "mapped")

    both = dealt("a", "b", 0).unionByName(dealt("b", "a", 1))
    fields = [*[(c, "bigint") for c in _TOTALS], *[(c, "double") for c in _EXTREMES]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in sorted_groups(batches):
            side = np.asarray(tile.column("side"))
            grids = np.stack([np.asarray(g.as_py(), float) for g in tile.column("grid")])
            copies, mapped = (np.asarray(tile.column(c)) for c in ("copies", "mapped"))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                found = _tile(grids[a], copies[a], mapped[a], grids[b], copies[b], mapped[b])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if kind == "bigint" else pa.float64()) for v, (_, kind) in zip(found, fields, strict=True)], names=[c for c, _ in fields])

    # pmod and hashes deal evenly; a pair of nodes with many contents is many tiles
    tiles = both.repartition("pair", "x", "y").sortWithinPartitions("pair", "x", "y").mapInArrow(measure, ", ".join(f"{c} {kind}" for c, kind in fields))
    return _summed(tiles.unionByName(batched), same_object_pairs(node_pairs, records))


def _summed(totals: DataFrame, same_object: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    rows = totals.unionByName(same_object, allowMissingColumns=True)
    totals = {c: F.coalesce(F.sum(c), zero) for c in _TOTALS}
    return rows.agg(
        totals["pairs"].alias("pairs"),
        totals["unmapped_pairs"].alias("unmapped_pairs"),
        (totals["pairs"] - totals["unmapped_pairs"]).alias("mapped_pairs"),
        F.coalesce(F.sum("mapped_same_object"), zero).alias("mapped_same_object"),
        *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _EXTREMES],
        *[totals[c].alias(c) for c in _TOTALS[2:]],
    )


def _tile(a: np.ndarray, copies_a: np.ndarray, mapped_a: np.ndarray, b: np.ndarray, copies_b: np.ndarray, mapped_b: np.ndarray) -> tuple:
    """Totals and extremes (None where no pair qualifies) over all pairs of rows of two matrices of grids."""
    pairs = copies_a[:, None] * copies_b[None]
    unmapped = pairs - mapped_a[:, None] * mapped_b[None]
    some = unmapped > 0
    inner, squares_a, squares_b = a @ b.T, (a * a).sum(axis=1), (b * b).sum(axis=1)
    norms = np.sqrt(squares_a)[:, None] * np.sqrt(squares_b)[None]
    cosine = np.divide(inner, norms, out=np.zeros_like(inner), where=norms > 0)
    count = a.shape[1]
    spread_a, spread_b = count * squares_a - a.sum(axis=1) ** 2, count * squares_b - b.sum(axis=1) ** 2
    both = (spread_a > 0)[:, None] & (spread_b > 0)[None]
    roots = np.sqrt(np.maximum(spread_a, 0))[:, None] * np.sqrt(np.maximum(spread_b, 0))[None]
    correlation = np.divide(count * inner - a.sum(axis=1)[:, None] * b.sum(axis=1)[None], roots, out=np.zeros_like(inner), where=both)
    level_a, level_b = (x / np.maximum(x.max(axis=1, keepdims=True), 1e-300) for x in (a, b))
    mae = np.stack([np.abs(row - level_b).mean(axis=1) for row in level_a])
    pixel = (correlation >= flags.REVIEW_CORRELATION) & (mae <= flags.REVIEW_MAE)
    embedding = cosine >= flags.REVIEW_COSINE
    extremes = (cosine.max(), *[float(v[some].max()) if some.any() else None for v in (cosine, correlation)], float(mae[some].min()) if some.any() else None)
    return int(pairs.sum()), int(unmapped.sum()), int(unmapped[embedding].sum()), int(unmapped[pixel].sum()), *extremes
