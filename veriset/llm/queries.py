"""One query per operator over the given tables, with SQL where SQL can express it.

The queries derive digests from the operators' outputs; parameters are the operators' own defaults.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm import bpe, conversations, linededup, mixing, neighbourgraph, privacy, quality, rollups, setjoin, sharding, simhash, spelling, sql, toxicity
from veriset.llm.common import table
from veriset.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take any other path as well."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_nn_descent")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    rows = table(spark, folder, "embeddings")
    return neighbourgraph.search_rows(rows, F.col("vec_id") % 100 == 0, k=10, key="vec_id", vector="embedding")


@query("op2_poisson_mix", sql.MIX)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the square root of their sources' sizes."""
    return mixing.poisson_mix(table(spark, folder, "documents")).select("doc_id", "source", F.col("copy").cast("bigint").alias("copy"), "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_two_pass_shuffle")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of equal row counts."""
    dealt = sharding.shuffle_to_shards(table(spark, folder, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_line_chunks", sql.LINES)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the passages that occurred before."""
    done = linededup.dedup_lines(table(spark, folder, "documents"))
    return done.select("doc_id", "n_chunks", "n_removed", "removed_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op5_simhash_pigeonring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_noisy_or")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    scored = toxicity.score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@query("op7_disclosure")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = privacy.sanitise(table(spark, folder, "documents"))
    # a second parameter of the lambda would be the place in the array
    of_kind = lambda i: F.filter("base", lambda s: s["kind_no"] == i)
    counts = [F.size(of_kind(i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(privacy.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"), privacy.listed(F.col("spans")).alias("spans"))


@query("op8_compression_bands")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    judged = quality.compression_bands(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_low", "chunks_high", "n_chunks", "verdict")


@query("op9_token_rollups")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after a load, the withdrawal of copies, a change of tokenizer and a repeated load."""
    import public_tokenizers

    documents = table(spark, folder, "documents")
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup = rollups.TokenRollup(spark, f"{checkpoint_root(spark).rstrip('/')}/veriset/{uuid.uuid4().hex}")
    named = documents.select("doc_id", "source", "lang", "text")
    counted = lambda df, name: rollups.count_tokens(df, vocabulary(f"{name}.tiktoken"), public_tokenizers.PATTERN).withColumn("tokenizer", F.lit(name)).drop("text")
    load = counted(named, first).withColumn("action", F.lit("insert"))
    rollup.apply("load", load)
    hashed = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    heads = hashed.groupBy("h").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = hashed.join(heads, "h").where("doc_id > head").select("doc_id").distinct()
    empty = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    rollup.apply("copies", copies.select(F.lit("delete").alias("action"), "doc_id", *empty, F.lit(first).alias("tokenizer"), F.lit(0).cast("bigint").alias("n_tokens")))
    foreign = counted(named.where("lang <> 'en'").join(copies, "doc_id", "left_anti"), second)
    rollup.apply("multilingual", foreign.withColumn("action", F.lit("revise")).withColumn("replaces", F.lit(first)))
    rollup.apply("load", load)
    return rollup.totals()


@query("op10_tree_concatenation")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and decoded text of every document, as digests."""
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path, keep_text=False), path)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_partenum")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Number of shingles and component of every document."""
    return setjoin.similar_sets(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Form, root and near words of every word of the documents."""
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_structure_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    found = conversations.audits(conversations.damaged(table(spark, folder, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
