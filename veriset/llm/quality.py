"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Each ratio (raw bytes over compressed bytes) must
lie in the band of its length and group (language): above the band the text repeats itself, below it the text is noise.
The bands come from the corpus: the middle ratio of all texts, or chunks, of a length and group, and how far below it
the lowest twentieth lies, which junk does not move. Where a length and group has few texts, fixed bands hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriset.llm.common import BLANKS, SLICE, texts_of
from veriset.session import materialise

#: Bands of lengths with few texts: (bytes below which the band holds, least ratio, greatest ratio).
#: The lower limits stand below natural text and above encoded or random characters (base64 reaches 1.33);
#: the upper ones at about twice what natural text of that length reaches.
BANDS = ((128, 0.0, 2.5), (512, 0.9, 3.0), (2048, 1.2, 4.0), (8192, 1.35, 4.5), (32768, 1.4, 5.0), (None, 1.4, 6.0))
CHUNK_BYTES = 4096
LEVEL = 3
#: Share of a text's chunks that may lie outside their bands; one always may.
CHUNK_SHARE = 0.25
#: Texts, or chunks, that a length and group needs for a band of its own.
LEAST = 100
#: The band reaches so many times the distance from the lowest twentieth to the middle below and above the middle.
BELOW, ABOVE = 3.0, 2.5
#: Ratios are counted in steps of this size.
STEP = 0.01
#: Groups whose bands may be sent to all tasks.
SENT = 10_000

SYMBOLS = "#*$%&|<>"

_FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("word_chars", T.LongType(), False),
    T.StructField("n_symbols", T.LongType(), False),
    T.StructField("n_dup_lines", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False),
    T.StructField("base_failed", T.BooleanType(), False),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("chunks_low", T.LongType(), False),
    T.StructField("chunks_high", T.LongType(), False),
    T.StructField("n_chunks", T.LongType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("kept", T.BooleanType(), False),
]


def band(size: int, bands=BANDS) -> tuple[float, float]:
    for below, low, high in bands:
        if below is None or size < below:
            return low, high
    return bands[-1][1:]


def pieces(raw: bytes, chunk_bytes: int) -> list[bytes]:
    """The chunks of a text that has more than one."""
    return [raw[start : start + chunk_bytes] for start in range(0, len(raw), chunk_bytes)] if len(raw) > chunk_bytes else []


def length_class(size: int) -> int:
    """Two classes for every doubling of the length."""
    return int(2 * math.log2(size))


def corpus_bands(df: DataFrame, text: str, group: str | None, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """(group, size, low, high): the bands of all length classes and groups with enough texts or chunks, from all of them.

    Tasks count ratios in steps, so that a few counts for each class leave them.
    """
    rows = df.select((F.lit(None) if group is None else F.col(f"`{group}`")).cast("string").alias("group"), F.col(f"`{text}`").cast("string").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress
        found: Counter[tuple] = Counter()

        def told() -> pa.RecordBatch:
            columns = zip(*[(*key, n) for key, n in found.items()], strict=True) if found else [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["group", "size", "step", "n"])
            found.clear()
            return batch

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                raw = (body.as_py() or "").encode()
                for piece in (raw, *pieces(raw, chunk_bytes)):
                    if piece:
                        found[name.as_py(), length_class(len(piece)), int(len(piece) / len(squeeze(piece)) / STEP)] += 1
                if len(found) > 100_000:
                    yield told()
        yield told()

    counts = rows.mapInArrow(count, "group string, size int, step bigint, n bigint").groupBy("group", "size", "step").agg(F.sum("n").alias("n"))
    # A class has few steps: a ratio is seldom above a hundred.
    order = Window.partitionBy("group", "size").orderBy("step")
    placed = counts.select("*", F.sum("n").over(order).alias("up_to"), F.sum("n").over(Window.partitionBy("group", "size")).alias("all"))
    at = lambda share: F.min(F.when(F.col("up_to") >= share * F.col("all"), F.col("step")))
    found = placed.groupBy("group", "size").agg(at(0.05).alias("edge"), at(0.5).alias("middle"), F.max("all").alias("all")).where(F.col("all") >= LEAST)
    reach = F.greatest(F.col("middle") - F.col("edge"), F.lit(2))
    return found.select("group", "size", ((F.col("middle") - BELOW * reach) * STEP).alias("low"), ((F.col("middle") + ABOVE * reach + 1) * STEP).alias("high"))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, reach = 0, 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + 3 - max(start, reach)
            reach = start + 3
    return covered


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def band_verdict(raw: bytes, squeeze, own: dict[int, tuple[float, float]], bands, chunk_bytes: int, chunk_share: float) -> tuple[float | None, int, int, int, str]:
    """Ratio of the whole, chunks below and above their bands, number of chunks, and the verdict in words.

    ``own`` are the bands of the text's group by length class; ``bands`` hold for the other lengths.
    """
    if not raw:
        return None, 0, 0, 0, "ok"

    def judged(piece: bytes) -> tuple[float, float, float]:
        return (len(piece) / len(squeeze(piece)), *(own.get(length_class(len(piece))) or band(len(piece), bands)))

    ratio, low, high = judged(raw)
    parts = [judged(p) for p in pieces(raw, chunk_bytes)] or [(ratio, low, high)]
    below, above, count = sum(r < least for r, least, _ in parts), sum(r > most for r, _, most in parts), len(parts)
    limit = max(1, chunk_share * count)
    if ratio > high or above > limit:
        return ratio, below, above, count, "repetitive"
    if ratio < low or below > limit:
        return ratio, below, above, count, "incompressible"
    return ratio, below, above, count, "ok"


def compression_bands(
    df: DataFrame, text: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, level: int = LEVEL, group: str | None = "lang"
) -> DataFrame:
    """Every row of ``df`` with the base counts, the compression figures, ``verdict`` and ``kept``.

    Bands are those of ``corpus_bands`` for the text's ``group`` (a missing column, or None: all texts are one group; null is a
    group). Null and empty texts have no words, a null ratio and the verdict ``ok``; they fail the base rule and are not kept.
    Repeated rows are judged alike and count as often in the bands. An empty table gives no rows. Input columns named like
    an added one are replaced, others pass through. A text is read whole, whatever its length, and one text is held at a time.
    """
    group = group if group in df.columns else None
    listed = corpus_bands(df, text, group, chunk_bytes, level).groupBy("group").agg(F.collect_list(F.struct("size", "low", "high")).alias("__own"))
    listed = materialise(listed.withColumnRenamed("group", "__group"))  # one row per group, sixty bands or so each
    names = {f.name for f in _FIELDS}
    kept = [f for f in df.schema.fields if f.name not in names]
    name = (F.lit(None) if group is None else F.col(f"`{group}`")).cast("string")
    few = F.broadcast(listed) if listed.count() <= SENT else listed
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").cast("string").alias("__text"), name.alias("__name"))
    source = rows.join(few, F.col("__name").eqNullSafe(F.col("__group")), "left").drop("__name", "__group")
    schema = T.StructType([*kept, *_FIELDS])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = []
                for value, own in zip(texts_of(part.column(part.num_columns - 2)), part.column(part.num_columns - 1), strict=True):
                    raw = value.encode()
                    counts = base_counts(value, raw)
                    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                    held = {b["size"]: (b["low"], b["high"]) for b in own.as_py() or ()}
                    verdict = band_verdict(raw, squeeze, held, bands, chunk_bytes, chunk_share)
                    found.append((*counts, failed, *verdict, not failed and verdict[4] == "ok"))
                columns = list(zip(*found, strict=True)) if found else [[] for _ in _FIELDS]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *[pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)]], names=schema.names)

    return source.mapInArrow(judge, schema)


_ARROW = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), *[pa.int64()] * 3, pa.string(), pa.bool_()]
