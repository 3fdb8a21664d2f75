"""Delta-maintained rollups of token counts.

A batch of inserts, deletes and revised counts becomes signed rows in a ledger: what a document counted so far is
subtracted, what it counts now is added. The batch's rows are summed by (source, lang, tokenizer) into a delta, and totals
are sums of deltas; no batch reads the documents of another. A batch is committed by a marker written after its rows, so
an interrupted batch leaves nothing visible, a repeated one replaces its own files, and a committed one is not applied
again.
"""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriset.llm.common import attach, texts_of

GROUP = ["source", "lang", "tokenizer"]
_LEDGER = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
_DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def count_tokens(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Rows of ``df`` with ``n_tokens`` of the whole text under a byte-level BPE given as a rank file; null counts 0.

    The rank file is read on the driver and broadcast (about a megabyte). An input column named n_tokens is replaced.
    """
    with open(ranks_path, "rb") as source:
        sent = df.sparkSession.sparkContext.broadcast(source.read())
    ready: list = []

    def compute(column: pa.Array) -> list[pa.Array]:
        if not ready:
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
            ready.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return [pa.array([len(ready[0].encode_ordinary(value)) for value in texts_of(column)], pa.int64())]

    return attach(df, text, [T.StructField("n_tokens", T.LongType(), False)], compute)


class TokenRollup:
    """Totals below ``folder``, which all executors and later sessions must reach. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, part: str, batch: str) -> str:
        return f"{self.folder}/{part}/{quote(batch, safe='').replace('%', '=')}"

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        files, where = self._files(f"{self.folder}/commits")
        return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/{name}" for name in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; false if it was committed before.

        ``changes``: action (insert, delete, revise), doc_id, source, lang, tokenizer, n_tokens, and optionally replaces,
        the tokenizer version that a delete or revision takes back (default: its own). An insert adds a row, also if the
        document is there already. A delete takes back all rows of (doc_id, replaces), a revision does so and adds one.
        Taking back what is not there changes nothing; several changes of one document take it back once. A null doc_id
        can be inserted but not taken back. Null source and lang are groups of their own, a null n_tokens counts 0.
        Further columns are ignored. An unknown action fails the batch.
        """
        files, marker = self._files(self._path("commits", batch))
        if files.exists(marker):
            return False
        if "replaces" not in changes.columns:
            changes = changes.withColumn("replaces", F.col("tokenizer"))
        known = F.col("action").isin("insert", "delete", "revise")
        checked = changes.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.lit("unknown action"))))
        back = checked.where("action <> 'insert' and doc_id is not null").select("doc_id", F.coalesce("replaces", "tokenizer").alias("tokenizer")).distinct()
        live = self._read("ledger", _LEDGER).join(back, ["doc_id", "tokenizer"], "left_semi").groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        taken = live.where("docs <> 0 or tokens <> 0").select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        given = checked.where("action <> 'delete'").select("doc_id", *GROUP, F.lit(1).cast("bigint").alias("docs"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"))
        rows = self._path("ledger", batch)
        taken.unionByName(given).write.mode("overwrite").parquet(rows)
        signed = self.spark.read.schema(_LEDGER).parquet(rows)
        signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(self._path("deltas", batch))
        files.create(marker, False).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups that fell to nothing are left out."""
        deltas = self._read("deltas", _DELTA)
        return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
