"""Removal of repeated passages by content-defined chunks of lines.

A text is cut into lines; a rolling hash over the hashes of neighbouring lines decides where a chunk ends. The decision
looks at the last lines only, so an insertion shifts no boundary but the nearest ones, and a passage falls into the same
chunks in every document. Chunks that occur again anywhere are compared byte by byte and removed, but for the first
occurrence. Only passages of several lines go: a chunk of one line is removed together with a repeated neighbour only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.session import materialise

#: A line here ends with a run of sentence ends, line feeds and blanks: long paragraphs often have no line feed inside.
#: Matches of the pattern, one after the other, give the whole text back.
LINE = r"[^.!?\n]+[.!?\n \t\r]*|[.!?\n \t\r]+"
#: A chunk ends where the rolling hash is divisible by this: chunks have about as many lines.
DIVISOR = 4
BASE = 31
#: Up to so many repeated hashes are broadcast.
BROADCAST_HASHES = 2_000_000
#: A paragraph end (sentence end, then line feed) always ends a chunk.
PARAGRAPH = r"[.!?][ \t\r]*\n"


def with_chunks(df: DataFrame, lines: str, out: str, divisor: int = DIVISOR) -> DataFrame:
    """Add an array of (n, text) chunks of an array of lines; no lines, no chunks.

    Each step is a column of its own and reads its neighbours from a shifted copy, so that the work is linear.
    """
    last = F.size(lines) - 1
    hashed = df.withColumn("__h", F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")))
    # A paragraph starts afresh, so that its chunks do not depend on the one before.
    carried = F.zip_with(lines, "__h", lambda line, h: F.when(line.rlike(PARAGRAPH), F.lit(0)).otherwise(h))
    shifted = hashed.withColumn("__b", F.concat(F.array(F.lit(0).cast("bigint")), F.slice(carried, 1, F.greatest(last, F.lit(0)))))
    rolled = shifted.withColumn("__r", F.zip_with("__h", "__b", lambda h, before: (before * BASE + h) % divisor == 0))
    ends = F.zip_with(lines, "__r", lambda line, rolls: rolls | line.rlike(PARAGRAPH))
    stops = rolled.withColumn("__e", ends).withColumn("__s", F.filter(F.transform("__e", lambda end, i: F.when(end | (i == last), i + 1)), lambda i: i.isNotNull()))
    starts = F.concat(F.array(F.lit(0)), F.slice("__s", 1, F.greatest(F.size("__s") - 1, F.lit(0))))
    pieces = F.zip_with(starts, "__s", lambda a, b: F.struct((b - a).alias("n"), F.array_join(F.slice(lines, a + 1, b - a), "").alias("text")))
    return stops.withColumn(out, F.when(F.size(lines) > 0, pieces)).drop("__h", "__b", "__r", "__e", "__s")


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR) -> DataFrame:
    """Rows of ``df`` with ``text`` cleaned, and n_chunks, n_removed and removed_chars.

    The first occurrence is the one with the smallest key (nulls first), then the first in the table, then the earliest
    in the text; it stays. A repetition within one text is removed as well. Repeated rows are documents of their own: all
    but one lose their repeated chunks. Null texts stay null, empty texts empty, with no chunk; a text whose chunks all
    go becomes empty, its row stays. Input columns named like an added one are replaced.
    """
    kept = [c for c in df.columns if c not in ("n_chunks", "n_removed", "removed_chars")]
    body = F.col(f"`{text}`").cast("string")
    numbered = df.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in kept], F.substring(body, 1, 0).alias("__empty"), F.regexp_extract_all(body, F.lit(LINE), F.lit(0)).alias("__lines"))
    cut = with_chunks(numbered, "__lines", "__chunks", divisor)
    hashed = cut.withColumn("__hashes", F.transform("__chunks", lambda c: F.xxhash64(c["text"]))).drop("__lines")
    # Written once: row numbers hold for good, and the hashes can be read without the texts.
    stored = materialise(hashed.drop(text))
    repeated = materialise(stored.select(F.explode("__hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    # Eight bytes a hash: up to a counted bound they go to the chunks, beyond it both sides meet in a shuffle.
    wanted = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    place = F.struct(F.col(f"`{key}`").alias("id"), F.col("__row").alias("row"), F.col("at"))
    found = (
        stored.select("__row", F.col(f"`{key}`"), F.posexplode(F.arrays_zip("__hashes", "__chunks")).alias("at", "c"))
        .select("__row", place.alias("place"), "at", F.col("c.__hashes").alias("h"), F.col("c.__chunks.text").alias("chunk"), (F.col("c.__chunks.n") > 1).alias("long"))
        .join(wanted, "h")
    )
    found = materialise(found)
    # Equal bytes, not only equal hashes, make a group.
    groups = found.groupBy("h", "chunk").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "chunk", "first")
    later = found.join(groups, ["h", "chunk"]).where(F.col("place") > F.col("first"))
    gone = later.groupBy("__row").agg(F.collect_list("at").alias("__gone"), F.collect_list(F.when(F.col("long"), F.col("at"))).alias("__long"))
    nowhere = F.array().cast("array<int>")
    own, alone = F.coalesce("__gone", nowhere), F.coalesce("__long", nowhere)
    # Chunks of several lines, and those whose neighbour before or behind goes as well.
    beside = F.array_union(F.array_intersect(own, F.transform(own, lambda i: i + 1)), F.array_intersect(own, F.transform(own, lambda i: i - 1)))
    joined = stored.join(gone, "__row", "left").withColumn("__cut", F.array_union(alone, beside))
    chunks = F.coalesce(F.col("__chunks"), F.array().cast(stored.schema["__chunks"].dataType))
    count = F.size(chunks)
    left = F.array_except(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(nowhere), "__cut")
    whole = F.array_join(F.transform(left, lambda i: F.get("__chunks", i)["text"]), "")
    return joined.select(
        *[(F.when(F.col("__chunks").isNull(), F.col("__empty")).otherwise(whole)).alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        count.cast("bigint").alias("n_chunks"),
        F.size("__cut").cast("bigint").alias("n_removed"),
        F.aggregate("__cut", F.lit(0).cast("bigint"), lambda acc, i: acc + F.length(F.get("__chunks", i)["text"])).alias("removed_chars"),
    )
