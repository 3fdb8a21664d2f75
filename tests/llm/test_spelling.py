"""Spelling variants against plain versions of words, nearness and chains."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import types as T

from veriset.llm import queries, spelling

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("word", T.StringType()), ("n", T.LongType()))])


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain(rows):
    words = plain_words(rows)
    deleted = {}
    for w in words:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            deleted.setdefault(d, set()).add(w)
    near = {w: {v for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in deleted[d] if one_edit(w, v)} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def crowd(seed, size):
    """Words of a small alphabet with many neighbours, repeats and frequent forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 12))) for _ in range(size)]
    for s in list(stems[: size // 2]):
        i = rng.randrange(len(s))
        stems += [s[:i] + s[i + 1 :], s[:i] + rng.choice("abéÿ") + s[i:], s[:i] + "z" + s[i + 1 :]]
    return [w for w in stems if len(w) >= 7]


def test_index_finds_every_pair():
    words = sorted(set(crowd(3, 300)))
    for turn in (lambda w: w, lambda w: w[::-1]):
        items = [turn(w) for w in words]
        index = spelling.WordIndex(items)
        import numpy as np

        halves = np.array([len(w) // 2 for w in items])
        query, word = index.near(items, halves)
        found = set(zip(query.tolist(), word.tolist(), strict=True))
        assert len(found) == len(query)
        wanted = {(i, j) for i, a in enumerate(items) for j, b in enumerate(items) if one_edit(a, b) and a[: len(a) // 2] == b[: len(a) // 2]}
        assert found == wanted


def test_near_words_over_small_bins(spark):
    words = sorted(set(crowd(4, 200)))
    df = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n bigint")
    wanted = sorted((a, b, j + 2) for a in words for j, b in enumerate(words) if one_edit(a, b))
    for size in (60, 1 << 18):  # crowded heads are dealt over many bins, or all words lie in one
        assert sorted(tuple(r) for r in spelling.near_words(df, size=size).collect()) == wanted


def test_variants_equal_plain_version(spark):
    rng = random.Random(9)
    words = crowd(5, 60)
    rows = [(i, " ".join(rng.choice(words[:8] if rng.random() < 0.8 else words) for _ in range(200)).title()) for i in range(40)]
    rows += [(None, None), (7, ""), (None, "ABÉABÉABAÉ " * 3), (3, "x" * 3_000 + " " + "x" * 3_000 + "1" + "x" * 2_999), (4, "x" * 2_999 + "×÷" * 9)]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    wanted = plain(rows)
    assert any(w[0] and w[1] != w[0] for w in wanted.values()) or any(w[0] for w in wanted.values())
    assert told(spelling.variants(df)) == wanted
    assert told(spelling.variants(df.limit(0))) == {}


def test_query_on_the_given_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op12(spark, folder)) == plain(rows)


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("v", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {**{f"w{i}": "w9" for i in range(9)}, "v": "w9"}
