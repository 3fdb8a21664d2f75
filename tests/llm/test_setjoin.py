"""The set join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from veriset.llm import queries, setjoin

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("sid", T.StringType()), ("key", T.LongType()))])


def shingles(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, percent=85):
    """(n, component) per row, by all pairs that share a shingle, and the links of different sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, first, links = {}, {}, set()
    for i, s in enumerate(sets):
        if s and s in first:
            parent[find(i)] = find(first[s])
        elif s:
            first[s] = i
            for x in s:
                holders.setdefault(x, []).append(i)
    for i in first.values():
        for j in {j for x in sets[i] for j in holders[x] if j > i}:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(j)] = find(i)
                links.add(frozenset((sets[i], sets[j])))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))], links


def near_copies(seed, groups, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 7, 9, 20, 60, 200, 900]))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [rng.choice(words)]
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy).upper())
    return rows


def told(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_similar_sets_share_a_signature():
    """Also without the common signatures that a set may do without."""
    rng = np.random.default_rng(3)
    for sets in (1000, 10**9):
        bands = setjoin.Bands(85, sets)
        for size in (6, 7, 12, 30, 77, 200, 1000):
            for _ in range(20):
                a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
                gone = rng.integers(0, size // 7 + 1)
                b = np.concatenate([a[gone:], rng.integers(1, 1 << 63, rng.integers(0, size // 12 + 1), dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                common = len(np.intersect1d(a, b))
                if 100 * common < 85 * (len(a) + len(b) - common) or len(a) == len(b) == common:
                    continue
                x, y = (set(setjoin.signatures(s, bands).tolist()) for s in (a, b))
                shared = x & y
                assert shared and max(sum(s & 255 == i for s in shared) - bands.surplus[i] for i in {s & 255 for s in shared}) > 0


def test_sketches_only_part_sets_that_are_apart():
    rng = np.random.default_rng(5)
    parted = 0
    for turn in range(2000):
        size = int(rng.integers(1, 400))
        a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[rng.integers(0, size // 4 + 1) :], rng.integers(1, 1 << 63, rng.integers(0, size // 4 + 1), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        apart = setjoin.surely_apart(setjoin.sketch(a), len(a), setjoin.sketch(b), len(b), 85)
        similar = 100 * common >= 85 * (len(a) + len(b) - common)
        assert not (apart and similar)
        parted += apart
        if turn % 10 == 0:
            assert not setjoin.surely_apart(setjoin.sketch(a), len(a), setjoin.sketch(a), len(a), 85)
    assert parted > 800


def test_components_equal_all_pairs(spark):
    texts = near_copies(1, 60, 6)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (None, "one  TWO"), (None, "alone here"), (5, texts[5]), (904, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    wanted, _ = plain(rows)
    assert told(setjoin.similar_sets(df)) == sorted(wanted, key=repr)
    assert setjoin.similar_sets(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2])
def test_a_crowd_of_near_copies(spark, crowd, monkeypatch):
    """Copies around one text and around each other, more than a signature may have before it is common."""
    monkeypatch.setattr(setjoin, "CHUNK", 16)
    monkeypatch.setattr(setjoin, "BLOCK", 20)
    rng = random.Random(crowd)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 6, 9])):
            copy[rng.randrange(300)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    wanted, links = plain(rows)
    found = setjoin.set_links(df, crowd=crowd)[2]
    listed = setjoin.set_links(df, every=True, crowd=crowd)[2]
    assert listed.select("a", "b").distinct().count() == listed.count() == len(links)
    assert found.join(listed, (found["a"] == listed["a"]) & (found["b"] == listed["b"]) | (found["a"] == listed["b"]) & (found["b"] == listed["a"])).count() == found.count()
    assert found.count() < len(links)
    assert told(setjoin.similar_sets(df)) == sorted(wanted, key=repr)


def test_query_on_the_given_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    wanted, _ = plain(rows)
    assert told(queries.op11(spark, folder)) == sorted(wanted, key=repr)
