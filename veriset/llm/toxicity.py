"""Toxicity by multiple-instance learning.

A document is toxic if one of its sentences is. A sentence has the score sigmoid(bias + sum of its words' weights), a
document the noisy-or of its sentences, 1 - prod(1 - score). Only documents are labelled; the gradient of the document's
loss reaches the sentences through the noisy-or, and afterwards the sentence scores show where the offence is.
A word's weight is the sum over hashed features: the word, its beginnings, which stand for stems, and its n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriset.llm.common import attach, texts_of

#: Documented bounds of the fit: labelled rows, and bytes of their texts. The scoring covers every row.
FIT_ROWS = 6_000
FIT_BYTES = 48 * 2**20
DIMENSIONS = 1 << 18
EPOCHS = 120
RATE = 1.0
MOMENTUM = 0.8
BIAS_SHARE = 0.5
#: Features in fewer fitted documents have no weight; SPARSE is the penalty on a weight's size.
LEAST_DOCUMENTS = 3
SPARSE = 3e-4
STEMS = (4, 5, 6, 7, 8)
GRAMS: tuple[int, ...] = ()
START_BIAS = -6.0
#: Words whose weights are remembered while scoring; the store is emptied when full.
REMEMBERED = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_=+~`/\\"


def sentences(text: str) -> Iterator[re.Match]:
    return _SENTENCE.finditer(text)


def features(word: str, dimensions: int = DIMENSIONS) -> list[int]:
    """Hashed features of a lower-cased word: itself, its beginnings and n-grams, with marks at both ends."""
    bare = word.strip(_EDGES)
    if not bare:
        return []
    marked = f"<{bare}>"
    parts = {marked} | {marked[: n + 1] for n in STEMS if n < len(bare)} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return sorted({xxhash.xxh32_intdigest(p.encode()) % dimensions for p in parts})


class _Bag:
    """Sentences of the fitted documents as numbered words, with the words' features."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[int] = []
        self.sentence_ends: list[int] = []
        self.document_ends: list[int] = []
        self.labels: list[int] = []

    def add(self, text: str, label: int) -> None:
        for match in sentences(text.lower()):
            found = match.group().split()
            if found:
                self.words.extend(self.numbers.setdefault(w, len(self.numbers)) for w in found)
                self.sentence_ends.append(len(self.words))
        if not self.document_ends and not self.sentence_ends or self.document_ends and self.document_ends[-1] == len(self.sentence_ends):
            self.sentence_ends.append(len(self.words))  # a text without words is one empty sentence
        self.document_ends.append(len(self.sentence_ends))
        self.labels.append(label)


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, empty ones included."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def fit_noisy_or(bag: _Bag, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps on the documents' log loss."""
    weights, bias = np.zeros(dimensions), START_BIAS
    labels = np.asarray(bag.labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return weights, START_BIAS if not len(labels) or labels.max() < 1 else -START_BIAS
    lists = [features(w, dimensions) for w in bag.numbers]
    feature_ends = np.cumsum([len(x) for x in lists])
    flat = np.fromiter((f for x in lists for f in x), np.int64, int(feature_ends[-1]))
    owner = np.repeat(np.arange(len(lists)), np.diff(np.concatenate(([0], feature_ends))))
    words, s_ends, d_ends = np.asarray(bag.words, np.int64), np.asarray(bag.sentence_ends), np.asarray(bag.document_ends)
    sentence_of = np.repeat(np.arange(len(s_ends)), np.diff(np.concatenate(([0], s_ends))))
    document_of = np.repeat(np.arange(len(d_ends)), np.diff(np.concatenate(([0], d_ends))))
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    # Features by the documents that hold them: what is seen too seldom is left out.
    holding = np.unique(np.stack([document_of[sentence_of], words], 1), axis=0)[:, 1]
    documents = np.bincount(flat, np.bincount(holding, minlength=len(lists))[owner], dimensions)
    used = documents >= LEAST_DOCUMENTS
    keep = used[flat]
    flat, owner = flat[keep], owner[keep]
    feature_ends = np.cumsum(np.bincount(owner, minlength=len(lists)))
    pace = rate / (documents / len(labels) + 0.01)  # common features take shorter steps
    slope = np.zeros(dimensions + 1)
    for _ in range(epochs):
        per_word = _segments(weights[flat], feature_ends)
        z = bias + _segments(per_word[words], s_ends)
        log_none = _segments(-np.logaddexp(0, z), d_ends)  # log of the probability that no sentence offends
        some = np.maximum(-np.expm1(log_none), 1e-12)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        # d loss / d z: p for a clean document, -p * (1 - P) / P for a toxic one.
        pull = np.where(labels > 0, -np.exp(log_none) / some, 1.0) * balance / len(labels)
        dz = p * pull[document_of]
        dword = np.bincount(words, dz[sentence_of], len(lists))
        grad = np.append(np.bincount(flat, dword[owner], dimensions), dz.sum())
        slope = MOMENTUM * slope + grad
        # No word excuses another: weights stay at zero or above. The penalty leaves weight to features that many documents ask for.
        weights = np.maximum(weights - pace * (slope[:-1] + SPARSE), 0.0)
        bias -= rate * slope[-1] * BIAS_SHARE
    return weights, float(bias)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", order: str = "order", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> tuple[np.ndarray, float]:
    """The model from at most ``rows`` labelled rows, the first by ``order``, and at most ``most_bytes`` of whole texts.

    One executor task fits; the driver receives the weights only (one array of DIMENSIONS numbers).
    """
    sample = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(order).alias("order")).orderBy("order", "text").limit(rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, taken = _Bag(), 0
        for batch in batches:
            for value, mark in zip(batch.column(0), batch.column(1), strict=True):
                body = value.as_py() or ""
                if taken + len(body.encode()) <= most_bytes:
                    taken += len(body.encode())
                    bag.add(body, int(mark.as_py() or 0))
        weights, bias = fit_noisy_or(bag)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([weights[used].tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["at", "w", "bias"])

    row = sample.coalesce(1).mapInArrow(learn, "at array<int>, w array<double>, bias double").first()
    weights = np.zeros(DIMENSIONS, np.float32)
    if row is None:  # no partition at all
        return weights, START_BIAS
    weights[np.asarray(row["at"], np.int64)] = row["w"]
    return weights, row["bias"]


class Scorer:
    """Sentence and document scores of one text at a time, with the words' weights remembered."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}

    def weight(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            value = self.known[word] = float(sum(self.weights[f] for f in features(word, len(self.weights))))
        return value

    def __call__(self, text: str, limit: float) -> tuple[float, list[dict]]:
        lowered = text.lower()
        same = len(lowered) == len(text)  # else positions would shift
        z, spans, weight, known = [], [], self.weight, self.known
        for match in sentences(lowered):
            words = match.group().split()
            if words:
                total = self.bias
                for w in words:
                    v = known.get(w)
                    total += weight(w) if v is None else v
                z.append(total)
                spans.append(match.span())
        if not z:
            return float(1 / (1 + np.exp(-self.bias))), []
        values = np.asarray(z)
        score = float(-np.expm1(-np.logaddexp(0, values).sum()))
        p = 1 / (1 + np.exp(-np.clip(values, -500, 500)))
        found = [{"start": spans[i][0] if same else None, "end": spans[i][1] if same else None, "score": float(p[i])} for i in np.flatnonzero(p >= limit)]
        return min(1.0, max(0.0, score)), found


def score_documents(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows of ``df`` with ``score``, ``predicted`` and ``offending`` (spans of code points and scores of the sentences found).

    Null and empty texts score as one empty sentence. Equal texts get equal scores. Spans are null in the rare texts
    whose length changes with lower case. Input columns named like an added one are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats: one megabyte
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False), T.StructField("offending", T.ArrayType(span), False)]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    scorers: dict[str, Scorer] = {}

    def compute(column: pa.Array) -> list[pa.Array]:
        if not scorers:
            scorers["one"] = Scorer(*sent.value)
        scorer = scorers["one"]
        found = [scorer(value, limit) for value in texts_of(column)]
        scores = [s for s, _ in found]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x for _, x in found], arrow)]

    return attach(df, text, fields, compute)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def score_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Every document scored by a model fitted on the labels of rows that are not held out.

    A key with several labels is toxic if one of them says so; null keys and null labels teach nothing. Without labelled
    rows, or with one label only, every document gets the score of that prior. Null keys count as not held out.
    """
    taught = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("label"))
    # The sample is the first FIT_ROWS keys by hash: a bounded table that Spark may broadcast.
    chosen = taught.withColumn("order", F.xxhash64("__key")).orderBy("order", "__key").limit(FIT_ROWS)
    named = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text"))
    model = fit(named.join(F.broadcast(chosen), "__key").select("text", "label", "order"))
    return score_documents(documents, model, text)
