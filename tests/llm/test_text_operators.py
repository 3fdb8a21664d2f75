"""Operators on texts against brute-force versions on odd rows and on the smallest tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from veriset.llm import bpe, linededup, mixing, privacy, quality, queries, rollups, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "One line here. Another line follows, with words. A third one ends it.\nThen a new paragraph starts. It has two sentences.\n"
MAIL = "write to ann.lee@mail.example.org or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1"

#: Nulls in each column, empty and blank texts, repeated rows, ties, a very long text, a long word, other scripts.
ODD = [
    (1, PROSE * 3, "en", "a"),
    (2, PROSE * 3, "en", "a"),
    (2, PROSE * 3, "en", "a"),
    (None, PROSE + "tail", None, None),
    (None, PROSE + "tail", None, None),
    (3, None, "en", "b"),
    (4, "", "en", "b"),
    (5, " \n\t ", None, "b"),
    (6, "x", "de", "a"),
    (7, "Ünïcode ß 漢字 ́ é 'S I'LL don't <|endoftext|> mixed", "fr", "c"),
    (8, MAIL + "\n" + MAIL.replace("1234", "9999"), "en", "c"),
    (9, "a b c " * 30_000, "en", "a"),
    (10, "abcdefgh" * 9_000, "en", "a"),
    (11, "don't" * 5_000 + "==" * 9_000 + "é漢ü" * 3_000, "en", "a"),
    (12, "nothing else. " * 80, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    plain = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    # Names that operators add or use inside.
    extra = {c: F.lit(f"own {c}") for c in ("fp", "ids", "kept", "score", "bucket", "slot", "copy", "n_chunks", "row", "key", "body", "h", "n", "a", "b")}
    return plain.withColumns(extra)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def given(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- quality ---------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    marked = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def squeezed(raw):
    return len(raw) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw))


def cut(raw):
    return [raw[i : i + 4096] for i in range(0, len(raw), 4096)] if len(raw) > 4096 else []


def brute_bands(rows):
    """(low, high) by group and length class, from sorted lists of all ratios."""
    import math

    held = {}
    for group, text in rows:
        raw = (text or "").encode()
        for piece in [raw, *cut(raw)]:
            if piece:
                held.setdefault((group, int(2 * math.log2(len(piece)))), []).append(int(squeezed(piece) / 0.01))
    bands = {}
    for key, steps in held.items():
        steps.sort()
        edge, middle = (steps[math.ceil(share * len(steps)) - 1] for share in (0.05, 0.5))
        reach = max(middle - edge, 2)
        if len(steps) >= 100:
            bands[key] = ((middle - 3.0 * reach) * 0.01, (middle + 2.5 * reach + 1) * 0.01)
    return bands


def brute_verdict(group, text, bands):
    import math

    raw = (text or "").encode()
    if not raw:
        return "ok"

    def place(piece):
        low, high = bands.get((group, int(2 * math.log2(len(piece))))) or quality.band(len(piece))
        ratio = squeezed(piece)
        return (ratio > high) - (ratio < low)

    parts = list(map(place, cut(raw)))
    limit = max(1, 0.25 * len(parts))
    if place(raw) > 0 or parts.count(1) > limit:
        return "repetitive"
    return "incompressible" if place(raw) < 0 or parts.count(-1) > limit else "ok"


@pytest.mark.parametrize("table", ["odd", "given", "more"])
def test_quality_counts_and_bands(request, spark, table):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if table == "more" else request.getfixturevalue(table)
    rows = quality.compression_bands(df).collect()
    assert len(rows) == df.count()
    group = (lambda r: r.lang) if "lang" in df.columns else (lambda r: None)
    bands = brute_bands((group(r), r.text) for r in rows)
    for r in rows:
        text = r.text or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        if text:
            assert r.ratio == pytest.approx(squeezed(text.encode()))
        assert r.verdict == brute_verdict(group(r), text, bands)
        assert r.kept == (not r.base_failed and r.verdict == "ok")
    assert bands or table != "more"


def test_quality_rejects_loops_and_noise_and_keeps_labelled_prose(spark):
    noise = "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ ", k=9000))
    rows = [(1, "the same again and more. " * 400), (2, noise)]
    verdicts = {r.doc_id: r.verdict for r in quality.compression_bands(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert verdicts == {1: "repetitive", 2: "incompressible"}
    folder = "/root/testdata/sf0.1"
    judged = quality.compression_bands(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "base_failed", "kept")
    counts = {(r.quality, r.kept): r["count"] for r in judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    # of the junk that the base rule lets pass more than half goes, of good texts one in a hundred at most
    assert counts[1, False] <= 0.01 * counts[1, True]
    assert counts[0, False] > counts[0, True]


# --- line dedup ------------------------------------------------------------------------------


def brute_chunks(text):
    lines = [m.group() for m in re.finditer(linededup.LINE, text)]
    chunks, open_, before = [], [], 0
    for line in lines:
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        open_.append(line)
        if (before * 31 + h) % 4 == 0 or re.search(linededup.PARAGRAPH, line):
            chunks.append(open_)
            open_ = []
        before = 0 if re.search(linededup.PARAGRAPH, line) else h
    return chunks + [open_] if open_ else chunks


def test_lines_give_the_text_back(odd, given):
    for df in (odd, given):
        for _, text in texts(df):
            assert "".join(line for chunk in brute_chunks(text) for line in chunk) == text


@pytest.mark.parametrize("table, broadcast", [("odd", 0), ("odd", 2_000_000), ("given", 0), ("given", 2_000_000)])
def test_line_dedup(request, monkeypatch, table, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_HASHES", broadcast)
    df = request.getfixturevalue(table)
    done = linededup.dedup_lines(df).collect()
    order = sorted(range(len(done)), key=lambda i: (done[i].doc_id is not None, done[i].doc_id or 0))
    inputs = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    seen, wanted = set(), []
    for key, text in inputs:
        chunks, again = brute_chunks(text or ""), []
        for chunk in chunks:
            again.append("".join(chunk) in seen)
            seen.add("".join(chunk))
        beside = [*again[1:], False], [False, *again]
        kept = ["".join(c) for c, g, a, b in zip(chunks, again, *beside, strict=False) if not (g and (len(c) > 1 or a or b))]
        wanted.append((key, None if text is None else "".join(kept)))
    found = [(done[i].doc_id, done[i].text) for i in order]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_line_dedup_removes_a_long_passage_from_all_but_one(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    para = lambda n: " ".join(" ".join(word() for _ in range(9)) + "." for _ in range(n)) + "\n"
    passage = para(7)
    rows = [(i, para(5) + passage + para(5)) for i in range(200)]
    done = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    holds = [r.doc_id for r in done if passage in r.text]
    assert holds == [0]
    words = len(passage.split())
    for r in done:
        if r.doc_id:
            left = len(dict(rows)[r.doc_id].split()) - len(r.text.split())
            assert left == words


# --- simhash ---------------------------------------------------------------------------------


def brute_fingerprint(text, shingle=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, distance=2):
    """pairs: (key, unsigned fingerprint) rows; the least key (nulls aside) for each fingerprint."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ np.uint64(f)) <= distance)
        for j in near:
            root[find(fps[i + 1 + j])] = find(f)
    least = {}
    for key, f in pairs:
        if key is not None:
            least[find(f)] = min(least.get(find(f), key), key)
    return {f: least.get(find(f)) for f in fps}


@pytest.mark.parametrize("table", ["odd", "given"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((k for k, _ in texts(df)), key=repr)
    wanted = Counter((k, brute_fingerprint(t)) for k, t in texts(df))
    assert Counter((r.doc_id, r.fp % 2**64) for r in rows) == wanted
    least = brute_components(list(wanted))
    assert all(r.component_id == least[r.fp % 2**64] for r in rows)


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_reach_what_brute_force_reaches(spark, crowd):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(25):
            f ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3]))})
            fps.add(f)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp bigint"), crowd=crowd).collect()
    assert all(bin((a ^ b) % 2**64).count("1") <= 2 for a, b in links)
    from veriset.llm.components import components

    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    wanted = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = {}
    for f in fps:
        s = f - 2**64 if f >= 2**63 else f
        groups.setdefault(wanted[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def brute_anchors(text, shingle):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return set()
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return {(k, min((h ^ h >> 29) * int(f) % 2**64 for h in hs)) for k, f in enumerate(simhash._FACTORS)}


def brute_kept(rows, shingle, distance=12):
    """Keys kept of (key, text) rows: one of each group of fingerprints within the distance that share an anchor."""
    fps = {}
    for key, text in rows:
        fps.setdefault(brute_fingerprint(text, shingle), []).append((key, text))
    nodes = sorted(fps)
    anchors = [set().union(*(brute_anchors(t, shingle) for _, t in fps[f])) for f in nodes]
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(nodes):
        for j in range(i):
            if bin(f ^ nodes[j]).count("1") <= distance and anchors[i] & anchors[j]:
                root[find(f)] = find(nodes[j])
    groups = {}
    for f in nodes:
        groups.setdefault(find(f), []).extend(k for k, _ in fps[f])
    return sorted((min(ks, key=lambda k: (k is None, k or 0)) for ks in groups.values()), key=repr)


@pytest.mark.parametrize("table", ["odd", "given"])
def test_keep_one_of_each_component(request, table):
    df = request.getfixturevalue(table)
    kept = simhash.keep_one(df, shingle=5)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == brute_kept(texts(df), 5)


def test_keep_one_finds_similar_texts_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CANDIDATES", 16)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    base = [word() for _ in range(400)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(400), 1 + i % 3):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(200)]
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5).collect()]
    assert set(range(1000, 1200)) <= set(kept)
    assert sum(k < 1000 for k in kept) <= 3 and 0 in kept


def test_chains_never_prune_a_close_pair():
    rng = random.Random(13)
    xs = np.array([sum({1 << b for b in rng.sample(range(64), rng.randrange(1, 13))}) for _ in range(20_000)], np.uint64)
    assert simhash.chained(xs, 12).all()
    far = np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert simhash.chained(far, 12).mean() < 0.2


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_separates_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op6(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [k for k in labels if rows[k].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    right = sum(rows[k].predicted == labels[k] for k in held)
    caught = [rows[k].predicted for k in held if labels[k]]
    # The given labels hold some marks that no word explains.
    assert right >= 0.96 * len(held) and sum(caught) >= 0.8 * len(caught)


def test_toxicity_on_odd_rows_and_location(spark, odd, none):
    words = "kind calm river stone walk talk green light paper table".split()
    rng = random.Random(2)
    docs = []
    for i in range(400):
        sentences = [" ".join(rng.choices(words, k=6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)] += " vileword"
        docs.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string, toxic int")
    scored = toxicity.score_toxicity(table.drop("toxic"), table.select("doc_id", "toxic")).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in scored)
    assert all("vileword" in r.text[s.start : s.end] for r in scored for s in r.offending)
    labels = table.select("doc_id", "toxic")
    again = toxicity.score_toxicity(odd, labels).collect()
    assert len(again) == len(ODD) and all(0 <= r.score <= 1 for r in again)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(odd, labels.where("false")).count() == len(ODD)


# --- personal data ---------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


TRICKY = [
    "a@b.com_x@y.org a@b a@b. @c.de a@@b.de a@b.c.d- ü@x.de éa.b@x-y.z 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 0000000000255.1.1.1",
    "1.2.3 4.5.6.7 +1 (2) 3.4-5 67 89 1 +12 +1234567890123456 4111-1111-1111-1111 4111  1111 1111 1111 1" + "2" * 30,
    "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 x 000000000000 +491234567890 ++12345678901 +1.2.3.4.5.6.7.8.9",
    "漢字 a@b.co 𝒳 10.0.0.1 é +1 212 555 0100",
    "9" * 50_000 + "@x.y " + "a." * 20_000 + " 1 2" * 20_000,
]


def test_base_spans(spark, odd, given):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id bigint, text string")
    for df in (odd, given, extra):
        found = privacy.sanitise(df).collect()
        got = Counter((r.doc_id, tuple((s.start, s.kind_no, s.end) for s in r.base)) for r in found)
        assert got == Counter((k, tuple(brute_pii(t))) for k, t in texts(df))
        for r in found:
            assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_counts_of_each_kind(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(50, "1.2.3.4 5.6.7.8 9.9.9.9"), (51, "a@b.c 1.2.3.4 d@e.f"), (52, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op7_disclosure"](spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found}
    assert got == {k: tuple(sum(s[1] == kind for s in brute_pii(t)) for kind in range(4)) for k, t in ((k, t or "") for k, t in rows)}


def test_terms_that_disclose(spark):
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(40)]
    line = lambda: " ".join(rng.choices(common, k=12))
    rows = [(i, line()) for i in range(400)]
    rows += [(1000 + i, f"{line()}\nmail to kim@corp.example about Zanzibarium {line()}\n{line()}") for i in range(6)]
    rows += [(2000 + i, f"copy kim@corp.example Onlycopied same line") for i in range(5)]
    found = {r.doc_id: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(found) == len(rows)
    for i in range(6):
        r = found[1000 + i]
        terms = [s.value for s in r.spans if s.kind_no >= 4]
        assert "Zanzibarium" in terms and not set(terms) & set(common)
        assert "kim@" not in r.sanitised and "Zanzibarium" not in r.sanitised and "[EMAIL]" in r.sanitised
    assert all("Onlycopied" not in [s.value for s in found[2000 + i].spans] for i in range(5))
    assert all(found[i].sanitised is None and not found[i].spans for i in range(400))


# --- BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("leaf", [64, 16_384])
def test_bpe_equals_the_library(odd, given, tokenizer, leaf):
    path = queries.vocabulary("word_bpe_49k.json")
    for df in (odd, given):
        rows = bpe.decode(bpe.encode(df, path, leaf=leaf), path).collect()
        assert sorted((r.doc_id for r in rows), key=repr) == sorted((k for k, _ in texts(df)), key=repr)
        for r in rows:
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_of_unsplit_text(tokenizer):
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    rng = random.Random(6)
    alphabets = ["abcdeinorst", "aeiou'stred", "é漢字üßaŁ", "=-+'!s", "0123ab", "áéo", "<|endoftext|>ab", "한글ㅏᅡᆨ가", "ab cd \n"]
    for n in range(600):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 120)))
        if n % 5 == 0:
            text += "<|endoftext|>" + text
        parts = [coder.leaf(p) for p in coder.pieces(text, rng.choice([2, 5, 17]))]
        assert coder.tree(parts).tokens().tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


# --- mixing, sharding, rollups ---------------------------------------------------------------


def test_mix_reaches_the_weights(spark, odd, none):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"), F.lit("t").alias("text"))
    weights = {"hot": 1.0, "s1": 2.0, "s2": 1.0}
    mixed = mixing.poisson_mix(docs, weights, total=40_000)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == set(weights)
    for s, w in weights.items():
        assert counts[s] == pytest.approx(10_000 * w, rel=0.04)
    copies = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("most")).where("n <> most").count()
    assert copies == 0
    again = mixing.poisson_mix(docs.repartition(7), weights, total=40_000)
    assert mixed.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).isEmpty()
    assert mixing.poisson_mix(odd).columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "copy"]
    assert mixing.poisson_mix(odd, total=3_000.0).groupBy("source").count().count() == 4
    assert mixing.poisson_mix(none).count() == 0
    with pytest.raises(Exception, match="max_rate"):
        mixing.poisson_mix(odd, total=1e9).count()


def test_mix_of_a_source_of_one_row(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "large").otherwise("rare").alias("source"))
    counts = {r.source: r["count"] for r in mixing.poisson_mix(docs, {"large": 1.0, "rare": 1.0}).groupBy("source").count().collect()}
    assert counts == {s: pytest.approx(1_500, rel=0.15) for s in ("large", "rare")}


def test_poisson_inversion():
    import math

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases = [(u, r) for r in (0.05, 0.7, 3.0, 15.9) for u in (1e-9, 0.2, 0.5, 0.9, 0.999, 1 - 1e-12)]
    rows = spark.createDataFrame(cases, "u double, r double").select("u", "r", mixing.poisson(F.col("u"), F.col("r")).alias("k")).collect()
    for row in rows:
        k, c = 0, math.exp(-row.r)
        while c < row.u:
            k += 1
            c += math.exp(-row.r + k * math.log(row.r) - math.lgamma(k + 1))
        assert row.k == k


def test_shards(spark, odd, none):
    docs = spark.range(5_003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    dealt = sharding.shuffle_to_shards(docs, 16, bucket_bytes=20_000).collect()
    assert sorted(r.doc_id for r in dealt) == list(range(5_003))
    by = {}
    for r in dealt:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = {r.doc_id: r.position for r in dealt}
    ranks = np.array([place[i] for i in range(5_003)])
    assert abs(np.corrcoef(np.arange(5_003), ranks)[0, 1]) < 0.05
    assert len({r.bucket for r in dealt}) > 10
    got = sharding.shuffle_to_shards(odd, 4)
    assert got.count() == len(ODD) and got.where("text is null").count() == 1
    assert sharding.shuffle_to_shards(none).count() == 0


def test_rollup_batches(spark, tmp_path):
    columns = "action string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, replaces string, extra string"
    made = lambda *rows: spark.createDataFrame([(*r, None, "x") if len(r) == 6 else (*r, "x") for r in rows], columns)
    roll = rollups.TokenRollup(spark, str(tmp_path))
    got = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert got() == {}
    load = made(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, "a", None, "v1", None), ("insert", None, None, "en", "v1", 7), ("insert", 2, "a", "en", "v1", 5))
    assert roll.apply("b/1", load) and not roll.apply("b/1", load)
    assert got() == {("a", "en", "v1"): (3, 20), ("a", None, "v1"): (1, 0), (None, "en", "v1"): (1, 7)}
    # An interrupted batch has files but no marker.
    load.select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("docs"), F.lit(99).cast("bigint").alias("tokens")).write.parquet(roll._path("deltas", "b2"))
    assert got()[("a", "en", "v1")] == (3, 20)
    assert roll.apply("b2", made(("delete", 2, None, None, "v1", None), ("delete", 77, None, None, "v1", None), ("revise", 1, "a", "en", "v2", 12, "v1")))
    assert got() == {("a", None, "v1"): (1, 0), (None, "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 12)}
    assert roll.apply("b3", made()) and len(roll.committed()) == 3
    with pytest.raises(Exception, match="unknown action"):
        roll.apply("b4", made(("drop", 1, "a", "en", "v1", 1)))
    assert len(roll.committed()) == 3


def test_rollup_query_counts_tokens(spark, folder, given):
    import base64

    import public_tokenizers
    import tiktoken

    def encoding(name):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    coders = {n: encoding(n) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    seen, wanted = set(), {}
    for r in sorted(given.collect(), key=lambda r: r.doc_id):
        if r.text in seen:
            continue
        seen.add(r.text)
        name = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
        docs, tokens = wanted.get((r.source, r.lang, name), (0, 0))
        wanted[r.source, r.lang, name] = docs + 1, tokens + len(coders[name].encode_ordinary(r.text))
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op9(spark, folder).collect()} == wanted


def test_empty_tables(none):
    path = queries.vocabulary("word_bpe_49k.json")
    assert quality.compression_bands(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert privacy.sanitise(none).count() == 0
    assert bpe.decode(bpe.encode(none, path), path).count() == 0


def test_bpe_store_of_words_stays_small(tokenizer, monkeypatch):
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    for text in ("a" * 5_000 + " b", "x" * 65 + " y", "die Straße", "b b y"):
        assert coder.closed(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert {len(w) > 64 for w in coder.known} == {False}  # words of any length cannot fill it
    often = 0
    for i in range(12_000):
        text = " ".join(f"w{i}n{j}" for j in range(25)) + " often"
        assert i % 500 or coder.closed(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        coder.closed(text)
        often += b"often" in coder.known
    assert often == 12_000 and len(coder.known) + len(coder.older) <= bpe.REMEMBERED
