"""64-bit hashes of one block within a few bits of each other: their pairs, the links that connect them, or their number.

Two hashes within t bits agree on one of some choices of bit bands, so the hashes are dealt into slots by the bits of each
choice. A slot holds about ``SLOT`` hashes and is compared as a bit matrix, XOR and population count, inside its task; a
slot with more than ``BLOCK`` hashes is cut into blocks, and every pair of blocks is a task of its own. Only what is asked for
leaves a task: pairs, the links of a spanning forest, or one number. All three are exact for any hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions.vectors import band_masks
from veriset.session import materialise

#: Hashes of a slot where the bits would spread them further, and of a block.
SLOT, BLOCK = 1024, 16_384
#: Comparisons that weigh as much as one dealt row, and those of a task.
ROW_COST, TASK = 400.0, 2e8
#: Dealt rows of a task.
ROWS = 200_000
#: The same as ROW_COST for a row with contents.
FULL_ROW_COST = 4000.0
#: Comparisons at a time, a matrix of a megabyte.
_CELLS = 1 << 17


def choose_bands(hashes: int, threshold: int, row_cost: float = ROW_COST) -> int:
    """Number of bands for which dealt rows plus comparisons cost least."""

    def cost(bands: int) -> float:
        keys = comb(bands, threshold)
        slots = min(2.0 ** (64.0 * (bands - threshold) / bands), max(1.0, hashes / SLOT))
        return keys * float(hashes) * (row_cost + hashes / slots / 2)

    return min(range(threshold + 1, 33), key=cost)


def _cells(hashes: DataFrame, block: str, weight: str, threshold: int, bands: int | None, size: int, carried: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """Rows (band, slot, x, y, own, mix, block, fp, weight), sorted by cell (band, slot, x, y), and the masks.

    With ``carried`` columns after them a hash may have several rows, which are dealt to blocks one by one.
    """
    count = hashes.count()
    bands = bands or choose_bands(count, threshold, FULL_ROW_COST if carried else ROW_COST)
    masks = band_masks(bands, bands - threshold)
    listed = F.array(*[F.lit(m).cast("bigint") for m in masks])
    named = hashes.select(F.xxhash64(block).alias("mix"), F.col(block).alias("block"), "fp", F.col(weight).cast("bigint").alias("weight"), *carried, F.posexplode(listed).alias("band", "mask"))
    slots = max(1, -(-count // SLOT))
    keyed = named.withColumn("slot", F.pmod(F.xxhash64("mix", F.col("fp").bitwiseAND(F.col("mask"))), F.lit(slots))).drop("mask")
    counted = materialise(keyed.groupBy("band", "slot").agg(F.count("*").alias("n")))
    sizes = counted.select("band", "slot", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    placed = keyed.join(sizes, ["band", "slot"]).withColumn("own", F.pmod(F.xxhash64("fp", "mix", *(["weight", *carried] if carried else [])), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("band", "slot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "mix", "block", "fp", "weight", *carried)
    # tasks by the comparisons of the slots as they are: bits of real hashes are far from even
    work = counted.agg(F.sum(F.col("n").cast("double") * F.col("n")) / 2).first()[0] or 0.0
    tasks = max(1, -(-count * len(masks) // ROWS), math.ceil(work / TASK))
    key = ["band", "slot", "x", "y"]
    return cells.repartition(tasks, *key).sortWithinPartitions(*key), np.array(masks, np.int64)


class _Cell:
    """Rows of one cell: the left and the right block, or one block with itself."""

    def __init__(self, table: pa.Table, masks: np.ndarray, threshold: int) -> None:
        self.table, self.threshold = table, threshold
        number = lambda name: np.asarray(table.column(name).combine_chunks())
        self.fp, self.mix, self.weight = number("fp").view(np.uint64), number("mix"), number("weight")
        band, self.alone = int(table.column("band")[0].as_py()), table.column("x")[0] == table.column("y")[0]
        own = number("own")
        self.left = np.flatnonzero(own == table.column("x")[0].as_py())
        self.right = self.left if self.alone else np.flatnonzero(own != table.column("x")[0].as_py())
        self.mask, self.earlier = masks[band].view(np.uint64), masks[:band].view(np.uint64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of pairs within the threshold for which this band is the first that they agree on."""
        return self._compared(self.left, self.right, self.alone)

    def crossing(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of different weights; rows of one weight are not compared."""
        left, right = self.weight[self.left], self.weight[self.right]
        for weight in np.unique(left):
            yield from self._compared(self.left[left == weight], self.right[right > weight if self.alone else right != weight], False)

    def _compared(self, left: np.ndarray, right: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(left) or not len(right):
            return
        hashes = self.fp[right]
        step = max(1, _CELLS // len(right))
        # written into again and again, the matrices stay in the processor's cache
        matrices = [np.empty((min(step, len(left)), len(right)), kind) for kind in (np.uint64, np.uint8, bool)]
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            difference, bits, near = (m[: len(rows)] for m in matrices)
            np.bitwise_xor(self.fp[rows][:, None], hashes[None], out=difference)
            np.bitwise_count(difference, out=bits)
            np.less_equal(bits, self.threshold, out=near)
            i, j = np.divmod(np.flatnonzero(near), len(right))
            if alone:
                i, j = i[i + start < j], j[i + start < j]
            i, j = rows[i], right[j]
            same = self.mix[i] == self.mix[j]
            i, j = i[same], j[same]
            apart = self.fp[i] ^ self.fp[j]
            first = (apart & self.mask) == 0
            for mask in self.earlier:
                first &= (apart & mask) != 0
            yield i[first], j[first]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what the pairs of this cell connect; between two blocks only links across them."""
        a, b = [], []
        for name in np.unique(self.mix[self.left]):
            left = self.left[self.mix[self.left] == name]
            groups, links = self._spread(left)
            if self.alone:
                a += [x for x, _ in links]
                b += [y for _, y in links]
            else:
                right = self.right[self.mix[self.right] == name]
                for i, j in self._across(groups, self._spread(right)[0]):
                    a.append(i)
                    b.append(j)
        lengths = [np.ndim(x) and len(x) or 1 for x in b]
        return (np.repeat(np.array(a, np.int64), lengths), np.concatenate([np.atleast_1d(x) for x in b])) if a else (np.empty(0, np.int64),) * 2

    def _near(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[others] ^ self.fp[i]) <= self.threshold

    def _spread(self, rows: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
        """Connected groups of rows and, for each row reached, the new ones next to it."""
        groups, links, left = [], [], rows
        while len(left):
            group, waiting, left = [], [left[0]], left[1:]
            while waiting:
                i = waiting.pop()
                group.append(i)
                near = self._near(i, left)
                if near.any():
                    links.append((i, left[near]))
                    waiting.extend(left[near].tolist())
                    left = left[~near]
            groups.append(np.array(group))
        return groups, links

    def _across(self, lefts: list[np.ndarray], rights: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """One link for each two groups that a pair connects, as long as they are not connected."""
        rows = np.concatenate(rights) if rights else np.empty(0, np.int64)
        group = np.repeat(np.arange(len(rights)), [len(r) for r in rights])
        for left in lefts:
            open_ = np.ones(len(rows), bool)  # right groups that this left group has no link to
            for i in left:
                if not open_.any():
                    break
                candidates = np.flatnonzero(open_)
                near = candidates[self._near(i, rows[candidates])]
                for g in np.unique(group[near]):
                    yield int(i), int(rows[near[group[near] == g][0]])
                    open_ &= group != g


def _run(cells: DataFrame, masks: np.ndarray, threshold: int, schema: str, told: Callable[[_Cell], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches):
            if table.num_rows > 1:
                yield from told(_Cell(table, masks, threshold))

    return cells.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int = 4) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first columns, four if not told, which are numbers, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)], axis=1)
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            own = key[start].tolist()
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def near_hashes(hashes: DataFrame, block: str, threshold: int, bands: int | None = None, size: int = BLOCK) -> DataFrame:
    """(block, fp_a, fp_b, distance): all pairs of distinct hashes of one block within ``threshold`` bits, each once.

    ``hashes`` holds distinct (block, fp, in_splits) rows, ``in_splits`` being a bit set of the splits that hold the hash;
    pairs that live in one and the same split are left out. A null block is no block.
    """
    kind = hashes.schema[block].dataType.simpleString()
    cells, masks = _cells(hashes.where(F.col(block).isNotNull()), block, "in_splits", threshold, bands, size)

    def told(cell: _Cell) -> Iterator[pa.RecordBatch]:
        fp, names = cell.fp.view(np.int64), cell.table.column("block").combine_chunks()
        for i, j in cell.pairs():
            w, v = cell.weight[i], cell.weight[j]
            wanted = ~((w == v) & (np.bitwise_count(w.view(np.uint64)) == 1))
            i, j = i[wanted], j[wanted]
            distance = np.bitwise_count(cell.fp[i] ^ cell.fp[j]).astype(np.int32)
            a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(a), pa.array(b), pa.array(distance)], names=["block", "also", "fp_a", "fp_b", "distance"])

    found = _run(cells, masks, threshold, f"block {kind}, also {kind}, fp_a bigint, fp_b bigint, distance int", told)
    return found.where("block = also").select(F.col("block").alias(block), "fp_a", "fp_b", "distance")


def near_forest(hashes: DataFrame, block: str, threshold: int, bands: int | None = None, size: int = BLOCK) -> DataFrame:
    """(block, fp_a, fp_b): links within ``threshold`` bits that connect what all such pairs connect.

    ``hashes`` holds distinct (block, fp). A slot gives at most as many links as it has hashes, and one more for each two of
    their groups that only meet across blocks, however many pairs there are.
    """
    kind = hashes.schema[block].dataType.simpleString()
    named = hashes.where(F.col(block).isNotNull()).select(block, "fp", F.lit(1).alias("weight"))
    cells, masks = _cells(named, block, "weight", threshold, bands, size)

    def told(cell: _Cell) -> Iterator[pa.RecordBatch]:
        i, j = cell.forest()
        fp, names = cell.fp.view(np.int64), cell.table.column("block").combine_chunks()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(fp[i]), pa.array(fp[j])], names=["block", "also", "fp_a", "fp_b"])

    found = _run(cells, masks, threshold, f"block {kind}, also {kind}, fp_a bigint, fp_b bigint", told)
    return found.where("block = also").select(F.col("block").alias(block), "fp_a", "fp_b")


def near_count(hashes: DataFrame, block: str, threshold: int, weight: str, bands: int | None = None, size: int = BLOCK) -> DataFrame:
    """One row: the sum over all pairs within ``threshold`` bits of the product of their weights; one number leaves a cell."""
    cells, masks = _cells(hashes.where(F.col(block).isNotNull()), block, weight, threshold, bands, size)

    def told(cell: _Cell) -> Iterator[pa.RecordBatch]:
        total = sum(int((cell.weight[i] * cell.weight[j]).sum()) for i, j in cell.pairs())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return _run(cells, masks, threshold, "n bigint", told).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


class Totals(NamedTuple):
    """What is added up over pairs: the columns of their rows that it takes, the schema of its result, and its making.

    ``begin()`` gives an object whose ``add(table, i, j)`` gets the places of pairs in the table of a cell, part by part, and
    whose ``row()`` is the result, a batch of one row.
    """

    carried: tuple[str, ...]
    schema: str
    begin: Callable


def near_totals(rows: DataFrame, block: str, threshold: int, weight: str, totals: Totals, bands: int | None = None, size: int = BLOCK) -> DataFrame:
    """``totals`` of all pairs of rows of one block within ``threshold`` bits whose weights differ, each once; a row per task.

    ``rows`` holds (block, fp, weight) and the carried columns; a hash may come in several rows. A null block is no block.
    """
    cells, masks = _cells(rows.where(F.col(block).isNotNull()), block, weight, threshold, bands, size, totals.carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = totals.begin(), False
        for table in sorted_groups(batches):
            if table.num_rows < 2:
                continue
            cell = _Cell(table, masks, threshold)
            names = np.asarray(table.column("block").combine_chunks().dictionary_encode().indices)
            for i, j in cell.crossing():
                wanted = names[i] == names[j]
                if wanted.any():
                    held.add(table, i[wanted], j[wanted])
                    some = True
        if some:
            yield held.row()

    return cells.mapInArrow(run, totals.schema)
