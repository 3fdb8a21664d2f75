"""Similarity join of shingle sets by PartEnum signatures.

Sets fall into bands of sizes; sets of one band and the next that are similar enough differ in at most k shingles. The
shingle domain is cut into n1 parts by hash, each part into n2 smaller ones. Of the parts, at least SURPLUS + 1 differ in k2
shingles or fewer; in such a part some n2 - k2 smaller parts are equal. So a set's signatures are its contents in every
such subset of every part, and two similar sets share a signature. n1, n2 and k2 follow from k and from the number of sets:
a signature must hold enough shingles to be rare.

A signature that many sets share (an empty part, a common passage) says little. A set that has no more of these than the
surplus can do without them, since a similar set then shares another one. Where sets are alike by the hundred, pairs are not
listed: the sets under a signature are first compared with its most central one, and only sets that are then still in
different components with each other. Candidates are confirmed on their whole shingle sets, those that their sketches do not
tell apart already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.llm.common import groups_of
from veriset.llm.components import components
from veriset.session import materialise

SHINGLE = 4
PERCENT = 85
#: Sets under a signature from which it is held for common.
CROWD = 32
#: Rounds of comparisons with central sets before the sets that are left are compared with one another.
ROUNDS = 2
#: Sets compared with one other set in a task.
CHUNK = 512
#: Sets of a block, where the sets left under a signature are compared with one another.
BLOCK = 512
#: Rows of three numbers that may be sent to all tasks.
SENT = 1_000_000
#: (k2, n2): differing smaller parts allowed, smaller parts of a part.
CUTS = ((0, 1), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (4, 8))
_SEEN = 200_000
_ROWS = 400_000


class Bands:
    """Size bands and the signature scheme of each; instance b joins sets of band b with those of b and b + 1."""

    def __init__(self, percent: int, sets: int) -> None:
        self.percent = percent
        low, high, lows, highs = 1, 0, [], []
        while low < 1 << 31:
            high = low * 100 // percent
            lows.append(low)
            highs.append(high)
            low = high + 1
        self.lows, self.highs = np.array(lows), np.array(highs)
        if len(lows) > 255:
            raise ValueError("the similarity is too high for the bands")
        self.target = math.log(max(2, sets)) / 3  # so that a signature without shingles is rare in any number of sets
        self.schemes = [self._scheme(int(lo), int(hi)) for lo, hi in zip(lows, highs, strict=True)]
        self.surplus = [0 if s is None else s[3] for s in self.schemes]

    def _scheme(self, low: int, high: int):
        """(n1, n2, subsets, surplus) of an instance, or None where only equal sets are similar."""
        most = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
        if most == 0:
            return None
        surplus = 1 + most // 16
        options = []
        for k2, n2 in CUTS:
            n1 = most // (k2 + 1) + 1 + surplus
            features = low / n1 * (n2 - k2) / n2
            options.append((features < self.target, n1 * math.comb(n2, k2) if features >= self.target else -features, n1, n2, k2))
        _, _, n1, n2, k2 = min(options)
        return n1, n2, _subsets(n2, n2 - k2), surplus

    def instances(self, size: int) -> list[int]:
        own = int(np.searchsorted(self.highs, size))
        return [b for b in (own, own - 1) if b >= 0 and self.schemes[b] is not None]


def _subsets(n: int, size: int) -> np.ndarray:
    """0/1 rows of all subsets of some size, as multipliers."""
    rows = [[i >> j & 1 for j in range(n)] for i in range(1 << n) if i.bit_count() == size]
    return np.array(rows, np.uint64)


_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words make one shingle, none an empty set."""
    words = text.encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = max(min(1, len(words)), len(words) - shingle + 1)
    mixed = hashes[:count]
    for place in range(1, min(shingle, len(words))):
        mixed = _mixed(mixed, _A) + hashes[place : place + count]
    return np.unique(_mixed(mixed, _B))


def sketch(hashes: np.ndarray) -> bytes:
    """Sums of the shingles of each of about as many parts as there are shingles, a byte each; halves add up to coarser parts."""
    parts = 1 << max(3, len(hashes).bit_length() - 1)
    place = (_mixed(hashes, _C) & np.uint64(parts - 1)).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, place, _mixed(hashes, _A) >> np.uint64(7))
    return sums.astype(np.uint8).tobytes()


def surely_apart(a: bytes, size_a: int, b: bytes, size_b: int, percent: int) -> bool:
    """Whether two sets cannot be similar, by their sketches: each differing part holds a differing shingle."""
    if 100 * min(size_a, size_b) < percent * max(size_a, size_b):
        return True
    width = min(len(a), len(b))
    x, y = (_folded(np.frombuffer(v, np.uint8), width) for v in (a, b))
    return int(np.count_nonzero(x != y)) * (100 + percent) > (100 - percent) * (size_a + size_b)


def digest_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures as signed numbers; the lowest eight bits are the instance."""
    found = []
    parts, smaller, worth = _mixed(hashes, _A), _mixed(hashes, _B), _mixed(hashes, _C)
    for b in bands.instances(len(hashes)):
        n1, n2, subsets, _ = bands.schemes[b]
        place = (parts % np.uint64(n1)) * np.uint64(n2) + smaller % np.uint64(n2)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, place.astype(np.int64), worth)
        weighted = _mixed(sums.reshape(n1, n2) + np.arange(1, n2 + 1, dtype=np.uint64) * _A, _B)
        each = weighted @ subsets.T + np.arange(n1, dtype=np.uint64)[:, None] * _B + np.arange(len(subsets), dtype=np.uint64) * _C
        found.append(_mixed(each.ravel(), _A) & ~np.uint64(255) | np.uint64(b))
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def _sized(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, mark, n, sid) of (key, mark, body)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column(2)]
            n, sid = pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, sid], names=["key", "mark", "n", "sid"])

    return rows.mapInArrow(run, f"key {kind}, mark bigint, n bigint, sid bigint")


def _signed(rows: DataFrame, bands: Bands, shingle: int) -> DataFrame:
    """(sig, sid) of the sets; a task passes on the sets that it has not just met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, sids, held = [], [], 0

        def out() -> pa.RecordBatch:
            counts = [len(s) for s in sigs]
            columns = [np.concatenate([np.empty(0, np.int64), *sigs]), np.repeat(np.array(sids, np.int64), counts)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sig", "sid"])

        for batch in batches:
            for value in batch.column(0):
                found = shingle_set(value.as_py() or "", shingle)
                sid = digest_of(found)
                if not len(found) or sid in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
                sigs.append(signatures(found, bands))
                sids.append(sid)
                held += len(sigs[-1])
                if held >= _ROWS:
                    yield out()
                    sigs, sids, held = [], [], 0
        yield out()

    return rows.select("body").mapInArrow(run, "sig bigint, sid bigint")


def _shared(signed: DataFrame) -> DataFrame:
    """Rows of signatures that several sets have, each once: one pass over sorted rows, whatever the size of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, True
        for batch in batches:
            sig, sid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if last is not None:
                sig, sid = np.append(last[0], sig), np.append(last[1], sid)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
            sig, sid = sig[new], sid[new]
            if not len(sig):
                continue
            alike = sig[1:] == sig[:-1]
            keep = np.append(alike, False) | np.append(False, alike)
            if last is not None and told:
                tell = keep.copy()
                tell[0] = False
            else:
                tell = keep
            # The last row stays open: the next batch may go on with its signature.
            told = bool(keep[-1]) if len(sig) > 1 or last is None else told
            last = (sig[-1], sid[-1])
            yield pa.RecordBatch.from_arrays([pa.array(sig[tell], pa.int64()), pa.array(sid[tell], pa.int64())], names=["sig", "sid"])

    return signed.repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(run, "sig bigint, sid bigint")


def _telling(shared: DataFrame, bands: Bands, crowd: int) -> DataFrame:
    """Rows without the common signatures of the sets that can do without them."""
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(shared.join(sizes, "sig").withColumn("instance", F.col("sig").bitwiseAND(F.lit(255)).cast("int")))
    common = rows.where(F.col("n") > crowd)
    spare = F.element_at(F.array(*[F.lit(s) for s in bands.surplus]), F.col("instance") + 1)
    free = common.groupBy("sid", "instance").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") <= spare).select("sid", "instance")
    kept = rows.where(F.col("n") <= crowd).unionByName(common.join(free, ["sid", "instance"], "left_anti").select(*rows.columns))
    return materialise(kept.select("sig", "sid"))


def _stars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pivots (sig, pivot), the set under each signature that has most company under all of its own, and pairs (hub, other)."""
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    company = rows.join(sizes, "sig").groupBy("sid").agg(F.sum("n").alias("company"))
    pivots = materialise(rows.join(company, "sid").groupBy("sig").agg(F.max_by("sid", "company").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "pivot"))
    return pivots, _once(rows.join(pivots, "sig").where("sid <> pivot").select(F.col("pivot").alias("hub"), F.col("sid").alias("other")))


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, as (hub, other)."""
    a, b = F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")
    once = pairs.groupBy(a, b).agg(F.min("hub").alias("hub"))
    return materialise(once.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")))


def _whole(sids: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(sid, n, parts, body): sketch and shingles of some sets, from one text of each."""
    wanted = sets.join(sids, "sid", "left_semi").select("sid", F.col("key").alias("k"), F.col("mark").alias("m"))
    wanted = _small(materialise(wanted))
    texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["k"]) & (rows["mark"] == wanted["m"])).select("sid", "body")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, found = [], []
                for sid, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if sid not in seen:  # repeated rows of one key and text
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(sid)
                        ids.append(sid)
                        found.append(shingle_set(body.as_py() or "", shingle))
                columns = pa.array(ids, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sketch(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns), names=["sid", "n", "parts", "body"])

    return materialise(texts.mapInArrow(listed, "sid bigint, n bigint, parts binary, body binary"))


def _small(table: DataFrame) -> DataFrame:
    """A written table of three numbers a row, sent to all tasks if it has few rows; else it meets the other side by a shuffle."""
    return F.broadcast(table) if table.count() <= SENT else table


def _confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b, common) of the pairs whose sets are similar.

    Pairs meet as sketches first. Of those left, a hub's set goes once to each of its chunks of other sets.
    """
    one, two = (whole.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("parts").alias(f"parts_{side}")) for side in ("hub", "other"))

    def compatible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            keep = pa.array([not surely_apart(a, n, b, m, percent) for n, a, m, b in rows], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    compared = pairs.join(one, "hub").join(two, "other").select("hub", "other", "n_hub", "parts_hub", "n_other", "parts_other")
    pairs = materialise(compared.mapInArrow(compatible, "hub bigint, other bigint"))
    chunks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = pairs.join(chunks, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("chunks")).alias("chunk"), F.col("other").alias("sid"))
    hubs = chunks.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("sid"))
    both = hubs.withColumn("place", F.lit(0)).unionByName(placed.withColumn("place", F.lit(1)))
    dealt = _small(materialise(both)).join(whole.select("sid", "body"), "sid").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "place").select("hub", "chunk", "place", "sid", "body")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, place, sid, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if place == 0:
                    hub, own = a, np.frombuffer(body.as_py(), np.uint64)
                    continue
                if a != hub:
                    raise ValueError("a set without its hub")
                other = np.frombuffer(body.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = int(np.count_nonzero(own[at] == other))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    found.append((hub, sid, common))
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "common"])

    return materialise(dealt.mapInArrow(compare, "a bigint, b bigint, common bigint"))


def _within(open_: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(hub, other): sets of different components under one signature that their sketches do not part.

    ``open_`` is (sig, sid, root). A signature of many sets is cut into blocks; two blocks meet in a task, where their sketches
    are compared as matrices, and only pairs that may be similar leave it.
    """
    sizes = open_.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = open_.join(sizes, "sig").join(whole.select("sid", "n", "parts"), "sid")
    spread = held.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("also", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("sig", F.least("own", "also").alias("x"), F.greatest("own", "also").alias("y"), "own", "sid", "root", "n", "parts")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]), pa.int64()) for i in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["hub", "other"])

        for group in groups_of(batches, 3):
            if len(found) > 10_000:
                yield told()
            if group.num_rows < 2:
                continue
            own, sid, root, n = (np.asarray(group.column(c)) for c in ("own", "sid", "root", "n"))
            sketches = [np.frombuffer(v, np.uint8) for v in group.column("parts").to_pylist()]
            width = min(map(len, sketches))
            parts = np.stack([_folded(v, width) for v in sketches])
            alone = group.column("x")[0] == group.column("y")[0]
            left = np.arange(len(sid)) if alone else np.flatnonzero(own == own.min())
            right = left if alone else np.flatnonzero(own != own.min())
            for i in left:
                others = right[right > i] if alone else right
                others = others[(root[others] != root[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
                apart = np.count_nonzero(parts[others] != parts[i], axis=1)
                near = others[apart * (100 + percent) <= (100 - percent) * (n[others] + n[i])]
                if len(near):
                    found.append((np.full(len(near), sid[i]), sid[near]))
        yield told()

    dealt = cells.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return _once(dealt.mapInArrow(meet, "hub bigint, other bigint"))


def _folded(parts: np.ndarray, width: int) -> np.ndarray:
    while len(parts) > width:
        parts = parts[: len(parts) // 2] + parts[len(parts) // 2 :]
    return parts


def _still_open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, sid, root) of signatures whose sets lie in several components."""
    placed = rows.select("sig", "sid").join(components(links.select("a", "b")), F.col("sid") == F.col("node"), "left").select("sig", "sid", F.coalesce("root", "sid").alias("root"))
    split = placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    return materialise(placed.join(split, "sig", "left_semi"))


def set_links(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, every: bool = False, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, mark, n, sid), sets (sid, n, key, mark), and links (a, b, common) of sets that are similar.

    The links connect whatever similar sets connect; with ``every``, all of them are listed.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("body"))
    sized = materialise(_sized(rows, shingle))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("first")
    sets = materialise(sized.where("n > 0").groupBy("sid").agg(F.max("n").alias("n"), first).select("sid", "n", "first.key", "first.mark"))
    bands = Bands(percent, sets.count())
    left = _telling(materialise(_shared(_signed(rows, bands, shingle))), bands, crowd)
    whole = _whole(left.select("sid").distinct(), sets, rows, shingle)
    links, tested = None, None
    for _ in range(0 if every else ROUNDS):
        pivots, pairs = _stars(left)
        found = _confirmed(pairs if tested is None else pairs.join(tested, _same(pairs, tested), "left_anti"), whole, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        # A pivot has met all sets under its signature.
        left = _still_open(left, links).join(pivots.withColumnRenamed("pivot", "sid"), ["sig", "sid"], "left_anti")
    if every:
        left = left.withColumn("root", F.col("sid"))
    rest = _within(left, whole, percent)
    if tested is not None:
        rest = rest.join(tested, _same(rest, tested), "left_anti")
    found = _confirmed(materialise(rest), whole, percent)
    return sized, sets, found if links is None else links.unionByName(found)


def _same(pairs: DataFrame, tested: DataFrame) -> Column:
    return (F.least(pairs["hub"], pairs["other"]) == F.least(tested["hub"], tested["other"])) & (F.greatest(pairs["hub"], pairs["other"]) == F.greatest(tested["hub"], tested["other"]))


def similar_sets(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, sid, component_id), one row for each row of ``df``.

    Two rows link if their sets of distinct shingles (A-Z in lower case) have at least ``percent`` of a hundred of their union
    in common. component_id is the smallest key that links reach; nulls count only where there is no other. Null and
    empty texts and texts without words have an empty set, which links with nothing: their component is their own key.
    Texts of fewer words than a shingle are one shingle. Equal sets share a component, repeated rows stay rows, an empty
    table gives none, and texts of any length are read whole. Other columns are not needed and may have any name. Sets and
    shingles are told apart by 64-bit digests.
    """
    sized, sets, links = set_links(df, text, key, shingle, percent)
    reached = sets.join(components(links.select("a", "b")), F.col("sid") == F.col("node"), "left").select("sid", "key", F.coalesce("root", "sid").alias("root"))
    least = reached.groupBy("root").agg(F.min("key").alias("component_id"))
    named = reached.join(least, "root").select(F.col("sid").alias("s"), "component_id")
    return sized.join(named, F.col("sid") == F.col("s"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "sid", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )
