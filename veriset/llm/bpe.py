"""BPE encoding and decoding with tree concatenation.

A text longer than a leaf is halved until its pieces are leaves; the pieces are rows of their own, so the leaves of one
text are encoded by several tasks. Then neighbours are joined in a tree. Around each join a window of tokens is encoded
again and grown until it agrees with the tokens on both sides.

Why agreement suffices: white space ends every BPE word, so only the stretch without white space around a cut can
change. Inside a stretch a token sequence is the encoding of its text if and only if each pair of neighbours is the
encoding of the pair's text. The left tokens, the window and the right tokens are each valid in that sense, and agreeing
on a token at either end of the window makes the pairs across valid too. Cuts and window ends stay away from places where
the pattern that splits words looks ahead (contractions), where characters compose, and from special tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriset.session import materialise

#: Rows encoded or decoded at a time inside a batch.
SLICE = 128
#: Code points of a leaf.
LEAF = 16_384
#: Words whose tokens are remembered (about 170 bytes each), and the longest one in bytes. A worker has its store for as long as it
#: lives and up to four workers share an executor, so that what they hold must not grow with the number of texts.
REMEMBERED, WORD = 262_144, 64

_BLANK = re.compile(r"[ \t\n\x0b\f\r]")
#: One sign after an ASCII letter and before white space is always a token sequence of its own.
_SIGN = re.compile(rb"([a-z])([.,;:!?])(?=[ \t\n\x0b\f\r]|\Z)")
#: Code points that never compose with what stands before them (letters of Latin, Greek, Cyrillic, Kana, Han, Hangul).
_STARTERS = ((0x21, 0x300), (0x370, 0x483), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))


class Stretch(NamedTuple):
    """Text without ASCII white space and its tokens with their spans."""

    text: str
    ids: list[int]
    starts: list[int]
    ends: list[int]


class Part(NamedTuple):
    """An encoded piece: the open stretches at its ends, and the closed tokens between. No tail: one stretch only."""

    head: Stretch
    middle: np.ndarray
    tail: Stretch | None

    def tokens(self) -> np.ndarray:
        ends = [self.head.ids, self.tail.ids if self.tail else []]
        return np.concatenate([np.asarray(ends[0], np.int32), self.middle.astype(np.int32), np.asarray(ends[1], np.int32)])


EMPTY = Stretch("", [], [], [])


class Coder:
    """A tokenizer with a bounded store of encoded words."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest = max(map(len, self.specials), default=0)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # words of the half before; those met again move on

    def stretch(self, text: str) -> Stretch:
        if not text:
            return EMPTY
        found = self.tokenizer.encode(text, add_special_tokens=False)
        starts, ends = zip(*found.offsets, strict=True) if found.ids else ((), ())
        return Stretch(text, found.ids, list(starts), list(ends))

    def closed(self, text: str) -> np.ndarray:
        """Tokens of a text whose ends are at white space, word by word."""
        raw = text.encode()
        if b"<|" not in raw:
            raw = _SIGN.sub(rb"\1 \2", raw.lower())  # the normaliser lowers case too; special tokens stay as they are
        words = raw.split()
        known = self.known
        missing = {w for w in words if w not in known}
        if not missing:
            return np.frombuffer(b"".join([known[w] for w in words]), self.kind)
        if len(known) + len(missing) > REMEMBERED // 2:
            self.older, self.known = known, (known := {})
            missing = set(words)
        older = self.older
        known |= {w: older[w] for w in missing if w in older}
        new = [w for w in missing if w not in older]
        for word, found in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, self.kind).tobytes()
        tokens = b"".join([known[w] for w in words])
        for word in new:
            if len(word) > WORD:
                del known[word]
        return np.frombuffer(tokens, self.kind)

    def leaf(self, text: str) -> Part:
        first = _BLANK.search(text)
        if first is None:
            return Part(self.stretch(text), np.empty(0, self.kind), None)
        last = len(text) - 1
        while not _BLANK.match(text, last):
            last -= 1
        return Part(self.stretch(text[: first.start()]), self.closed(text[first.start() : last]), self.stretch(text[last + 1 :]))

    def safe(self, text: str, at: int) -> bool:
        """Whether words before and after ``at`` are split alike with and without the other side."""
        if at <= 0 or at >= len(text):
            return True
        if _BLANK.match(text[at - 1]) or _BLANK.match(text[at]):
            return True
        code = ord(text[at])
        if "'" in text[max(0, at - 3) : at + 1] or not any(a <= code < b for a, b in _STARTERS):
            return False
        around = text[max(0, at - self.longest + 1) : at + self.longest - 1]
        return not any(s in around for s in self.specials)

    def cut(self, text: str) -> int | None:
        """The safe place nearest to the middle."""
        middle = len(text) // 2
        for away in range(middle):
            for at in (middle - away, middle + away):
                if 0 < at < len(text) and self.safe(text, at):
                    return at
        return None

    def pieces(self, text: str, leaf: int) -> list[str]:
        if len(text) <= leaf:
            return [text]
        at = self.cut(text)
        return [text] if at is None else self.pieces(text[:at], leaf) + self.pieces(text[at:], leaf)

    def join(self, left: Stretch, right: Stretch) -> Stretch:
        if not left.text:
            return right
        if not right.text:
            return left
        text, shift, width = left.text + right.text, len(left.text), 1
        while True:
            first = max(0, len(left.ids) - width)
            while first > 0 and not (left.starts[first] >= left.ends[first - 1] and self.safe(text, left.starts[first])):
                first -= 1
            count = min(width, len(right.ids))
            whole_left, whole_right = first == 0, count == len(right.ids)
            begin = 0 if whole_left else left.starts[first]
            stop = len(text) if whole_right else shift + right.ends[count - 1]
            window = self.stretch(text[begin:stop])
            if whole_left and whole_right:
                return window
            agrees = whole_left or bool(window.ids) and window.ids[0] == left.ids[first] and window.starts[0] == 0 and window.ends[0] == left.ends[first] - begin
            splice = (len(window.ids), len(right.ids)) if whole_right else self._meeting(text, window, begin, right, shift, count)
            if agrees and splice:
                head = 0 if whole_left else first
                k, j = splice
                return Stretch(
                    text,
                    left.ids[:head] + window.ids[:k] + right.ids[j:],
                    left.starts[:head] + [s + begin for s in window.starts[:k]] + [s + shift for s in right.starts[j:]],
                    left.ends[:head] + [s + begin for s in window.ends[:k]] + [s + shift for s in right.ends[j:]],
                )
            width *= 2

    def _meeting(self, text: str, window: Stretch, begin: int, right: Stretch, shift: int, count: int) -> tuple[int, int] | None:
        """The last token of the window, but the very last, that the right side has too."""
        own = {(right.starts[j] + shift, right.ends[j] + shift, right.ids[j]): j for j in range(count) if j == 0 or right.starts[j] >= right.ends[j - 1]}
        for k in range(len(window.ids) - 2, 0, -1):
            at = window.starts[k] + begin
            if at < shift:
                return None
            j = own.get((at, window.ends[k] + begin, window.ids[k]))
            if j is not None and window.starts[k] >= window.ends[k - 1] and self.safe(text, at):
                return k, j
        return None

    def merge(self, a: Part, b: Part) -> Part:
        if a.tail is None:
            return Part(self.join(a.head, b.head), b.middle, b.tail)
        if b.tail is None:
            return Part(a.head, a.middle, self.join(a.tail, b.head))
        between = np.asarray(self.join(a.tail, b.head).ids, self.kind)
        return Part(a.head, np.concatenate([a.middle, between, b.middle]), b.tail)

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(maxsize=2)
def coder_of(definition: str) -> Coder:
    """One coder per worker process and definition, so that tasks share the store of words."""
    return Coder(definition)


@lru_cache(maxsize=2)
def decoder_of(definition: str, skip_special_tokens: bool):
    """A function from token numbers to text. Without a decoder of its own a tokenizer puts a blank between tokens."""
    tokenizer = coder_of(definition).tokenizer
    if tokenizer.decoder is not None or skip_special_tokens:
        return lambda ids: tokenizer.decode([] if ids is None else ids.tolist(), skip_special_tokens=skip_special_tokens)
    tokens = np.array([tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())], object)
    return lambda ids: "" if ids is None else " ".join(tokens[ids].tolist())


def _lists(rows: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow keeps of earlier ones goes back to the system, since idle workers hold on to it otherwise."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


_STRETCH = "struct<text:string,ids:array<int>,starts:array<int>,ends:array<int>>"


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", leaf: int = LEAF, keep_text: bool = True) -> DataFrame:
    """Rows of ``df`` with ``ids``, the tokens of the whole text without special tokens added.

    Null and empty texts have no tokens; equal texts get equal tokens. Strings of special tokens inside a text are
    encoded as the tokenizer itself does. An input column named ids is replaced; the text column is left out unless
    ``keep_text``. The definition at ``tokenizer_path`` is read on the driver and broadcast (a file of a few megabytes).
    It must be of a tokenizer that ends words at white space and drops it, as that of CLIP models.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as source:
        sent = spark.sparkContext.broadcast(source.read())
    kept = [f for f in df.schema.fields if f.name != "ids" and (keep_text or f.name != text)]
    here = F.struct(F.lit(True).alias("here"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    named = df.select(here.alias("own"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    own = named.schema["own"].dataType
    ids = T.StructField("ids", T.ArrayType(T.IntegerType(), False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in _tidy(batches):
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([coder.closed(v.as_py()) for v in part.column(1)])], names=["own", "ids"])

    # How a text is cut depends on its own length only; the result does not.
    direct = named.where(F.length("body") <= leaf).mapInArrow(short, T.StructType([T.StructField("own", own), ids]))
    long = materialise(named.where(F.length("body") > leaf).withColumn("row", F.monotonically_increasing_id()))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in _tidy(batches):
            for i in range(batch.num_rows):
                found = coder.pieces(batch.column(1)[i].as_py(), leaf)
                # The row's other columns travel with its first piece.
                carried = batch.column(0).take(pa.array([i, *[None] * (len(found) - 1)], pa.int32()))
                yield pa.RecordBatch.from_arrays([carried, pa.array([batch.column(2)[i].as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["own", "row", "no", "piece"])

    kinds = [("text", pa.string()), *[(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")]]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in _tidy(batches):
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [coder.leaf(v.as_py()) for v in part.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([p.head._asdict() for p in found], pa.struct(kinds)),
                        pa.array([p.middle.tobytes() for p in found], pa.binary()),
                        pa.array([p.tail and p.tail._asdict() for p in found], pa.struct(kinds)),
                    ],
                    names=["own", "row", "no", "head", "middle", "tail"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row, first, parts = coder_of(sent.value), None, None, []

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([first, _lists([coder.tree(parts).tokens()])], names=["own", "ids"])

        for batch in _tidy(batches):
            for i in range(batch.num_rows):
                current, no, head, middle, tail = (batch.column(k)[i].as_py() for k in range(1, 6))
                if no == 0:
                    if parts:
                        yield result()
                    row, first, parts = current, batch.column(0).slice(i, 1), []
                assert current == row
                parts.append(Part(Stretch(**head), np.frombuffer(middle, coder.kind), Stretch(**tail) if tail else None))
        if parts:
            yield result()

    def fields(*more: tuple[str, str]) -> T.StructType:
        return T.StructType([T.StructField("own", own), T.StructField("row", T.LongType()), T.StructField("no", T.IntegerType()), *[T.StructField(n, T.StructType.fromDDL(f"x {k}")["x"].dataType) for n, k in more]])

    pieces = long.select("own", "body", "row").mapInArrow(halve, fields(("piece", "string")))
    encoded = pieces.repartition("row", "no").mapInArrow(leaves, fields(("head", _STRETCH), ("middle", "binary"), ("tail", _STRETCH)))
    joined = encoded.repartition("row").sortWithinPartitions("row", "no").mapInArrow(gather, T.StructType([T.StructField("own", own), ids]))
    return direct.unionByName(joined).select(*[F.col(f"own.c{i}").alias(f.name) for i, f in enumerate(kept)], "ids")


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", skip_special_tokens: bool = False) -> DataFrame:
    """Rows of ``df`` with ``decoded``, the text of the tokens; null or no tokens give the empty text.

    An input column named decoded is replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as source:
        sent = df.sparkSession.sparkContext.broadcast(source.read())
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    at = [f.name for f in kept].index(ids)
    names = [*[f.name for f in kept], "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder_of(sent.value, skip_special_tokens)
        for batch in _tidy(batches):
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [text_of(np.asarray(row.values) if row.is_valid else None) for row in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    source = df.select(*[F.col(f"`{f.name}`") for f in kept])
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.StringType())]))
