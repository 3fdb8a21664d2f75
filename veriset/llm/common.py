"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words of the text contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` cuts at exactly these, so words are taken from the UTF-8 form.
BLANKS = " \t\n\x0b\f\r"


#: Rows computed at a time inside a batch.
SLICE = 512


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(column: pa.Array) -> Iterator[str]:
    """One string at a time, null as the empty text, so that a batch is never held twice."""
    for value in column:
        yield value.as_py() or ""


def attach(df: DataFrame, text: str, fields: list[StructField], compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Add columns computed per Arrow batch from one text column.

    All other columns pass through unchanged; an input column with the name of an added one is replaced.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([*kept, *fields])
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *compute(part.column(part.num_columns - 1))], names=labels)

    return source.mapInArrow(run, schema)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            values = np.asarray(batch.column(k))
            marks[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
