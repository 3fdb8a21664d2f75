"""Grouping of spelling variants: words at one edit, found by search schemes over bidirectional FM indexes.

If two words differ by one inserted, deleted or replaced character, one half of the first word is whole in the other: a
search starts with either half, matched exactly from the word's border, and extends across the other half with one error.
The left half is extended to the right, so it needs the index of the reversed text; the right half is extended to the left
and needs the index of the text itself. The two indexes are built of words dealt by their first and by their last
characters, so a search only meets the bins that can hold its half; a crowded key is dealt over several bins, each of
which its searches visit. A bin's text is the delimited list of its words. Suffixes are ordered up to their delimiter, and
a search holds an interval of their ranks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.llm.common import groups_of
from veriset.session import materialise

SHORTEST = 7
LEAST = 2
RATIO = 10
#: Code points of a bin.
BIN = 1 << 18
#: Words counted in a task before their counts are passed on.
COUNTED = 200_000
#: Searches that run together, and the largest interval whose next characters are read one by one.
TOGETHER, FEW = 4096, 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def damaged(word: str, key: object) -> str:
    """The word, or, for one of 31 hashes of key and word, the word without one character."""
    mark = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    if mark % 31:
        return word
    place = mark % len(word)
    return word[:place] + word[place + 1 :]


def vocabulary(df: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, damage: bool = True) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters and their number of occurrences, at least ``least``.

    Words are the longest runs of Latin letters of whole texts, A-Z in lower case. With ``damage`` some lose a character, by a
    hash of document and word; a null key counts as the empty text there. Null and empty texts have no words, equal rows
    count as often as they are there, an empty table gives none. Other columns are not needed and may have any name.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                words, own = runs.findall(body.as_py() or ""), name.as_py()
                lower = [w.translate(_LOWER) for w in words]
                if damage:
                    lower = [w for w in (damaged(w, own) for w in lower) if len(w) >= shortest]
                found.update(lower)
                if len(found) >= COUNTED:
                    yield batch_of()
                    found.clear()
        yield batch_of()

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))
    counted = rows.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WordIndex:
    """FM index of a list of distinct words that extends a match to the right."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = _symbols("".join(words))
        self.alphabet = np.unique(symbols)
        # The words, each behind a delimiter 0, and all of it reversed: a match to the right grows to the left here.
        text = np.zeros(int(lengths.sum()) + len(words), np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        text[np.arange(len(symbols)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = np.searchsorted(self.alphabet, symbols) + 1
        text = text[::-1]
        size = self.size = len(text)
        ends = np.flatnonzero(text == 0)
        ahead = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size)  # characters before the delimiter
        rank, width = text, 1
        while width <= int(ahead.max(initial=0)):
            following = np.zeros(size, np.int64)
            inside = np.flatnonzero(ahead >= width)
            following[inside] = rank[inside + width] + 1
            rank = np.unique(rank * (int(following.max()) + 1) + following, return_inverse=True)[1]
            width *= 2
        order = np.argsort(rank, kind="stable")  # equal suffixes stay in text order, as the last-to-first mapping needs
        self.before = text[order - 1]
        self.keys = np.sort(self.before * (size + 1) + np.arange(size))
        self.words = len(words)
        # Where a whole word begins in the reversed text, by its place in the list.
        self.word_at = np.full(size, -1, np.int64)
        self.word_at[size - starts - lengths] = np.arange(len(words))
        self.order = order

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of characters from 1; those that no word holds get a code that matches nothing."""
        place = np.searchsorted(self.alphabet, symbols)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == symbols
        return np.where(known, place + 1, len(self.alphabet) + 1)

    def extend(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals of the matches followed by a character."""
        base = code * (self.size + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def following(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, code) of every character that follows a match of some states."""
        few = high - low <= FEW
        states, widths = np.flatnonzero(few), (high - low)[few]
        rows = np.repeat(low[few] - np.cumsum(widths) + widths, widths) + np.arange(int(widths.sum()))
        pairs = np.unique(np.repeat(states, widths) * (len(self.alphabet) + 2) + self.before[rows])
        many = np.flatnonzero(~few)
        state = np.concatenate([pairs // (len(self.alphabet) + 2), np.repeat(many, len(self.alphabet))])
        code = np.concatenate([pairs % (len(self.alphabet) + 2), np.tile(np.arange(1, len(self.alphabet) + 1), len(many))])
        return state[code > 0], code[code > 0]

    def whole(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that a match is in whole, or -1: the one row of the interval that a delimiter precedes."""
        heads = self.keys[: self.words]
        place = np.searchsorted(heads, low)
        row = heads[np.minimum(place, self.words - 1)]
        return np.where((place < self.words) & (row >= low) & (row < high), self.word_at[self.order[row]], -1)

    def near(self, patterns: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) at one edit with the first ``halves`` characters of the pattern exact; each pair once."""
        found = [self._near(patterns[i : i + TOGETHER], halves[i : i + TOGETHER], i) for i in range(0, len(patterns), TOGETHER)]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))

    def _near(self, patterns: list[str], halves: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, patterns), np.int64, len(patterns))
        start = np.cumsum(length) - length
        code = np.append(self.codes(_symbols("".join(patterns))), 0)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.words, np.int64)
        for t in range(int(halves.max(initial=0))):
            live = np.flatnonzero((halves > t) & (low < high))
            low[live], high[live] = self.extend(low[live], high[live], code[start[live] + t])
        q = np.flatnonzero(low < high)
        exact = (q, halves[q], low[q], high[q])
        wrong = tuple(np.empty(0, np.int64) for _ in range(4))
        pairs = []
        while len(exact[0]) or len(wrong[0]):
            q, at, low, high = wrong
            done = at == length[q]
            word = self.whole(low[done], high[done])
            pairs.append(np.unique(q[done][word >= 0] * self.words + word[word >= 0]))
            q, at, low, high = (x[~done] for x in wrong)
            low, high = self.extend(low, high, code[start[q] + at])
            next_wrong = [(q, at + 1, low, high)]

            q, at, low, high = exact
            inside = at < length[q]
            state, char = self.following(low, high)
            new_low, new_high = self.extend(low[state], high[state], char)
            next_wrong.append((q[state], at[state], new_low, new_high))  # one more character in the word
            other = inside[state] & (char != code[start[q[state]] + at[state]])
            next_wrong.append((q[state][other], at[state][other] + 1, new_low[other], new_high[other]))  # another one
            next_wrong.append((q[inside], at[inside] + 1, low[inside], high[inside]))  # one less
            q, at, low, high = (x[inside] for x in exact)
            low, high = self.extend(low, high, code[start[q] + at])
            exact = tuple(x[low < high] for x in (q, at + 1, low, high))
            wrong = tuple(np.concatenate([p[i] for p in next_wrong]) for i in range(4))
            kept = wrong[2] < wrong[3]
            wrong = tuple(x[kept] for x in wrong)
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return found // max(1, self.words) + first, found % max(1, self.words)


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def near_words(words: DataFrame, shortest: int = SHORTEST, size: int = BIN) -> DataFrame:
    """(word, near, near_n) of every two words that one inserted, deleted or replaced character apart, both ways round.

    ``words`` is (word, n) with distinct words of at least ``shortest`` characters, 2 at least.
    """
    if shortest < 2:
        raise ValueError("both halves of a word need a character")
    known = shortest // 2
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("item")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("item")))
    items = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.item", F.substring("s.item", 1, known).alias("head"))
    # One row per side and run of ``known`` letters, however many words there are.
    heads = materialise(items.groupBy("side", "head").agg(F.sum(F.length("item") + 1).alias("weight")))
    bins = int((heads.agg(F.sum("weight")).first()[0] or 0) / 2 / size) + 1
    placed = items.join(heads, ["side", "head"]).select(
        "side", F.pmod(F.xxhash64("head"), F.lit(bins)).alias("bin"), "word", "n", "item",
        F.pmod(F.xxhash64("item"), F.ceil(F.col("weight") / size)).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("weight") / size) - 1)).alias("part"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            side = group.column("side")[0].as_py()
            held = group.filter(np.asarray(group.column("own")) == np.asarray(group.column("part")))
            if not held.num_rows:
                continue
            items = group.column("item").to_pylist()
            lengths = np.fromiter(map(len, items), np.int64, len(items))
            index = WordIndex(held.column("item").to_pylist())
            for start in range(0, len(items), TOGETHER):
                part = slice(start, start + TOGETHER)
                left = lengths[part] // 2
                query, word = index.near(items[part], left if side == 0 else lengths[part] - left)
                asked, near = group.column("word").slice(start).take(query), held.column("word").take(word)
                if side == 1:
                    # Pairs whose left halves are equal too are the other side's.
                    keep = np.array([a[: len(a) // 2] != b[: len(a) // 2] for a, b in zip(asked.to_pylist(), near.to_pylist(), strict=True)], bool)
                    asked, near, word = asked.filter(keep), near.filter(keep), word[keep]
                yield from pa.table([asked, near, held.column("n").take(word)], names=["word", "near", "near_n"]).combine_chunks().to_batches()

    # As many tasks as bins on both sides, so that small tables are not searched in one.
    dealt = placed.repartition(2 * bins, "side", "bin", "part").sortWithinPartitions("side", "bin", "part").select("side", "bin", "part", "own", "word", "item", "n")
    return dealt.mapInArrow(search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain, by jumps that double; chains must end."""
    jumps = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        jumped = materialise(jumps.join(further, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")))
        moved = not jumped.where("moved").isEmpty()
        jumps = jumped.select("word", "root")
        if not moved:
            return jumps


def variants(df: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, damage: bool = True, size: int = BIN) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    The form is the most frequent word at one edit (of equal ones the first in code-point order), if it is at least ``ratio``
    times as frequent; the root is the end of the chain of forms, or the word itself. Words come from ``vocabulary``, which
    states what nulls, empty texts and empty tables give; long texts are read whole, and a word of any length is searched.
    """
    words = materialise(vocabulary(df, text, key, shortest, least, damage))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, shortest, size).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = materialise(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
        )
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
