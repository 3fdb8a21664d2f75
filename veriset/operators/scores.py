"""Class probabilities from features, predictions from probabilities, ensembles and controls."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.functions import vectors
from veriset.operators import confusion, splits
from veriset.operators.nearhash import sorted_groups
from veriset.session import materialise

#: Labels of a block of a model, and rows that meet a block in a task.
BLOCK_LABELS, BLOCK_ROWS = 4096, 8192

# --- scorers -------------------------------------------------------------------------------


def centroids(features: DataFrame, label: str = "target", vector: str = "features") -> DataFrame:
    """Mean unit vector per label as (label, centroid); partial sums are combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    means = features.groupBy(label).agg(mean.alias("mean"))
    return means.select(label, vectors.unit_vector(vector_to_array("mean")).alias("centroid"))


def centroid_scores(features: DataFrame, model: DataFrame, label: str = "target", vector: str = "features", sharpness: float = 10.0, size: int = BLOCK_LABELS) -> DataFrame:
    """Replace the vector by ``probs``: softmax of the cosine to each label's centroid, at the label's place.

    Labels are indices from 0; one that the model has not seen gets probability 0. A model of one block is read once and
    shipped with the tasks, where a matrix product per Arrow batch takes the place of labels x dimensions expression steps
    per row. A larger one meets the rows block by block; ``centroid_predictions`` then spares the wide vectors.
    """
    fitted = model.orderBy(label).limit(size + 1).collect()
    others = tuple(c for c in features.columns if c != vector)
    if len(fitted) <= size:
        weights = np.array([row["centroid"] for row in fitted])
        return score_batches(features, cosine_scorer(weights, sharpness, [int(row[label]) for row in fitted]), vector, others)
    rows, met = _against_blocks(features, model, label, vector, size)

    def logits(block: pd.DataFrame, labels: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        whole = np.full((len(block), size), -np.inf)
        whole[:, labels % size] = scores
        return block[["_row", "_block"]].assign(logits=list(whole))

    parts = met(logits, "_row bigint, _block bigint, logits array<double>", sharpness)
    # a wide row is its blocks in order, cut behind the last label; a block without labels has no chance
    count = int(model.agg(F.max(label)).first()[0]) + 1
    by_block = parts.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_block", "logits"))).alias("held"))
    none = F.array_repeat(F.lit(-math.inf), size)
    whole = F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit((count - 1) // size).cast("bigint")), lambda b: F.coalesce(F.try_element_at("held", b), none)))
    joined = by_block.select("_row", F.slice(whole, 1, count).alias("logits"))
    return rows.join(joined, "_row").select(*others, vectors.softmax(F.col("logits")).alias("probs"))


def centroid_predictions(features: DataFrame, model: DataFrame, label: str = "target", vector: str = "features", sharpness: float = 10.0, size: int = BLOCK_LABELS) -> DataFrame:
    """What ``predictions`` says of ``centroid_scores``, for models of any number of labels.

    A block of labels gives a row its highest logit, the label of it, the sum of exponents below it and the logit of the true
    label. These merge, so no row holds a number per label.
    """
    rows, met = _against_blocks(features, model, label, vector, size)

    def best(block: pd.DataFrame, labels: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        at = scores.argmax(axis=1)
        top = scores[np.arange(len(block)), at]
        place = np.searchsorted(labels, block["_target"].to_numpy())
        known = labels[np.minimum(place, len(labels) - 1)] == block["_target"].to_numpy()
        truth = np.where(known, scores[np.arange(len(block)), np.minimum(place, len(labels) - 1)], -np.inf)
        return pd.DataFrame({"_row": block["_row"], "top": top, "label": labels[at], "total": np.exp(scores - top[:, None]).sum(axis=1), "truth": truth})

    parts = met(best, "_row bigint, top double, label int, total double, truth double", sharpness)
    # one entry per block
    merged = parts.groupBy("_row").agg(F.max("top").alias("top"), F.max("truth").alias("truth"), F.collect_list(F.struct("top", "label", "total")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["total"] * F.exp(p["top"] - F.col("top")))
    label_of = F.array_min(F.transform(F.filter("parts", lambda p: p["top"] == F.col("top")), lambda p: p["label"]))
    told = merged.select("_row", label_of.alias("predicted_index"), (1.0 / total).alias("confidence"), (F.exp(F.col("truth") - F.col("top")) / total).alias("true_probability"))
    others = [c for c in features.columns if c not in (vector, "target")]
    found = rows.join(told, "_row").select(*others, F.col("target").alias("true_index"), "predicted_index", "confidence", "true_probability")
    return found.withColumn("correct", F.col("true_index") == F.col("predicted_index"))


def _against_blocks(features: DataFrame, model: DataFrame, label: str, vector: str, size: int):
    """Numbered rows, and a function that runs a kernel over every block of labels and chunk of rows.

    The kernel gets the rows (_row, _block, _target), the labels of the block in order, and rows x labels logits.
    """
    rows = materialise(features.withColumn("_row", F.monotonically_increasing_id()))
    chunks = rows.count() // BLOCK_ROWS + 1
    block = F.expr(f"cast({label} as bigint) div {size}")
    labels = materialise(model.where(F.col(label).isNotNull()).select(block.alias("_block"), F.col(label).cast("bigint").alias("_row"), F.col("centroid").cast("array<double>").alias("_vector")))
    target = F.col("target").cast("bigint") if "target" in features.columns else F.lit(-1).cast("bigint")
    numbered = rows.select("_row", F.coalesce(target, F.lit(-1)).alias("_target"), F.col(vector).cast("array<double>").alias("_vector"), F.pmod(F.xxhash64("_row"), F.lit(chunks)).alias("_chunk"))
    # every block of labels meets every row: that is the result, not a detour
    listed = labels.agg(F.array_sort(F.collect_set("_block")).alias("all")).first()["all"]
    left = numbered.withColumn("_block", F.explode(F.array(*[F.lit(b) for b in listed]).cast("array<bigint>")))
    right = labels.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))).withColumn("_target", F.lit(-1).cast("bigint"))
    columns = ["_block", "_chunk", "_side", "_row", "_target", "_vector"]
    # one flat table, labels before rows: cogroups of nested arrays broke the Arrow stream when a task had several groups
    both = right.withColumn("_side", F.lit(0)).select(*columns).unionByName(left.withColumn("_side", F.lit(1)).select(*columns))
    dealt = both.repartition("_block", "_chunk").sortWithinPartitions("_block", "_chunk", "_side", "_row")

    def met(kernel: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str, sharpness: float) -> DataFrame:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        told = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in sorted_groups(batches, keys=2):
                number = lambda name: np.asarray(group.column(name).combine_chunks())  # noqa: B023, E731
                cut = int((number("_side") == 0).sum())
                if not 0 < cut < group.num_rows:
                    continue
                vectors_of = lambda part: np.stack(part.column("_vector").to_pandas().to_numpy())
                names = number("_row")[:cut].astype(np.int32)
                scorer = cosine_scorer(vectors_of(group.slice(0, cut)), sharpness)
                block = pd.DataFrame({"_row": number("_row")[cut:], "_block": number("_block")[cut:], "_target": number("_target")[cut:]})
                yield pa.RecordBatch.from_pandas(kernel(block, names, scorer(vectors_of(group.slice(cut)))), schema=told, preserve_index=False)

        return dealt.mapInArrow(run, schema)

    return rows, met


def score_batches(features: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], vector: str = "features", id_columns: tuple[str, ...] = ("id", "target")) -> DataFrame:
    """Run a user-supplied batch function (rows x features -> rows x logits) and apply the softmax.

    The function sees one Arrow batch at a time; a model it closes over is shipped with the task.
    """
    kept = features.select(*id_columns, vector)
    fields = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in id_columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(id_columns)].copy()
            if len(batch):
                out["logits"] = list(np.asarray(scorer(np.stack(batch[vector].to_numpy())), dtype=np.float64))
            else:
                out["logits"] = pd.Series([], dtype=object)
            yield out

    scored = kept.mapInPandas(run, f"{fields}, logits array<double>")
    return scored.withColumn("probs", vectors.softmax(F.col("logits"))).drop("logits")


def cosine_scorer(weights: np.ndarray, sharpness: float = 10.0, labels: list[int] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Batch scorer of a fitted (labels x features) matrix of unit vectors; ``labels`` are the places of its rows."""
    places = np.arange(len(weights)) if labels is None else np.asarray(labels)

    def score(block: np.ndarray) -> np.ndarray:
        block = block.astype(np.float64)
        norms = np.sqrt((block * block).sum(axis=1, keepdims=True))
        unit = np.divide(block, norms, out=np.zeros_like(block), where=norms > 0)
        logits = np.full((len(block), int(places.max()) + 1), -np.inf)
        logits[:, places] = unit @ weights.T * sharpness
        return logits

    return score


def linear_head(train: DataFrame, label: str = "target", vector: str = "features", iterations: int = 20):
    """Multinomial logistic regression on frozen features."""
    prepared = train.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return LogisticRegression(maxIter=iterations, regParam=1e-4, family="multinomial").fit(prepared)


def linear_scores(features: DataFrame, head, vector: str = "features", id_columns: tuple[str, ...] = ("id", "target")) -> DataFrame:
    prepared = features.select(*id_columns, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return head.transform(prepared).select(*id_columns, vector_to_array("probability").alias("probs"))


# --- predictions ---------------------------------------------------------------------------


def predictions(scored: DataFrame) -> DataFrame:
    """One row per record: prediction, confidence, probability of the truth, and correctness."""
    return (
        scored.withColumn("predicted_index", vectors.predicted_index(F.col("probs")))
        .withColumn("confidence", F.array_max("probs"))
        .withColumn("true_probability", vectors.true_probability(F.col("probs"), F.col("target")))
        .withColumnRenamed("target", "true_index")
        .withColumn("correct", F.col("true_index") == F.col("predicted_index"))
    )


def named_predictions(predicted: DataFrame, classes: DataFrame) -> DataFrame:
    """Attach class names by lookup in the class dimension."""
    for side in ("true", "predicted"):
        names = classes.select(F.col("class_index").alias(f"{side}_index"), F.col("class_name").alias(f"{side}_class"))
        predicted = predicted.join(names, f"{side}_index", "left")
    return predicted


def soft_vote(first: DataFrame, second: DataFrame, second_weight: float, keys: tuple[str, ...] = ("id", "target")) -> DataFrame:
    """Weighted mean of two models' probabilities, joined on the record id and not on row position."""
    right = second.select(*keys, F.col("probs").alias("_second"))
    return first.join(right, list(keys)).select(
        *keys, vectors.blended(F.col("probs"), F.col("_second"), F.lit(second_weight)).alias("probs")
    )


def weight_search(first: DataFrame, second: DataFrame, labels: int, eligible: tuple[float, ...] = (0.25, 0.5, 0.75), keys: tuple[str, ...] = ("id", "target")) -> DataFrame:
    """Metrics per ensemble weight and the chosen one: best macro-F1, then lowest loss, eligible only.

    Every record is blended once per weight in place; only confusion cells and loss sums are shuffled.
    """
    weights = F.array(*[F.lit(float(w)) for w in sorted({0.0, *eligible, 1.0})])
    right = second.select(*keys, F.col("probs").alias("_second"))
    blended = (
        first.join(right, list(keys))
        .withColumn("weight", F.explode(weights))
        .withColumn("probs", vectors.blended(F.col("probs"), F.col("_second"), F.col("weight")))
    )
    predicted = blended.select(
        "weight",
        F.col("target").alias("true_index"),
        vectors.predicted_index(F.col("probs")).alias("predicted_index"),
        vectors.log_loss_term(vectors.true_probability(F.col("probs"), F.col("target"))).alias("loss"),
    )
    # weights x labels x labels rows, written once: quality, loss and choice all read them.
    cells = materialise(
        predicted.groupBy("weight", "true_index", "predicted_index").agg(F.count("*").alias("count"), F.sum("loss").alias("loss"))
    )
    quality = confusion.averages(confusion.class_report(cells, labels, ["weight"]), ["weight"])
    loss = cells.groupBy("weight").agg((F.sum("loss") / F.sum("count")).alias("validation_loss"))
    table = quality.join(loss, "weight").select(
        F.col("weight").alias("second_weight"),
        (1.0 - F.col("weight")).alias("first_weight"),
        F.col("weight").isin(list(eligible)).alias("eligible"),
        "validation_loss",
        F.col("accuracy").alias("validation_accuracy"),
        F.col("macro_f1").alias("validation_macro_f1"),
    )
    best = table.filter("eligible").agg(
        F.min_by("second_weight", F.struct(-F.col("validation_macro_f1"), F.col("validation_loss"), F.col("second_weight"))).alias("w")
    )
    return table.select("*", best.scalar().alias("_best")).withColumn("chosen", F.col("second_weight") == F.col("_best")).drop("_best")


def chosen_vote(first: DataFrame, second: DataFrame, search: DataFrame, keys: tuple[str, ...] = ("id", "target")) -> DataFrame:
    """Soft vote with the weight that a validation search chose."""
    weight = search.filter("chosen").agg(F.min("second_weight").alias("w"))
    right = second.select(*keys, F.col("probs").alias("_second"))
    joined = first.join(right, list(keys)).select("*", weight.scalar().alias("_w"))
    return joined.select(*keys, vectors.blended(F.col("probs"), F.col("_second"), F.col("_w")).alias("probs"))


# --- conditions and controls ---------------------------------------------------------------


def under_conditions(features: DataFrame, conditions: dict[str, Callable[[Column], Column]], vector: str = "features") -> DataFrame:
    """One copy of every record per condition, its vector changed by the condition's expression."""
    variants = F.array(
        *[F.struct(F.lit(name).alias("condition"), change(F.col(vector)).alias("v")) for name, change in conditions.items()]
    )
    others = [c for c in features.columns if c != vector]
    return features.select(*others, F.explode(variants).alias("_c")).select(
        *others, F.col("_c.condition").alias("condition"), F.col("_c.v").alias(vector)
    )


def permutation_control(features: DataFrame, labels: int, train_per_class: int, fit_and_score: Callable[[DataFrame, DataFrame], DataFrame], seed: int = 42, pass_below: float = 0.10) -> DataFrame:
    """Train on shuffled labels, evaluate on true ones: a sound protocol scores near chance.

    ``features`` is (id, class, split, features); ``fit_and_score(train, validation)`` gets tables with
    ``target`` and returns the validation rows with ``probs``. The fit sees a sample, every validation row is scored.
    """
    train = materialise(splits.balanced_sample(features.filter(F.col("split") == "train"), train_per_class, seed))
    validation = features.filter(F.col("split") == "validation")
    shuffled = materialise(splits.permuted_labels(train, "class", seed))
    fitted_on = train.join(shuffled.select("id", F.col("permuted").alias("target")), "id")
    scored = predictions(fit_and_score(fitted_on, validation.withColumn("target", F.col("class"))))
    quality = confusion.averages(confusion.class_report(confusion.cells(scored), labels))
    unchanged = shuffled.agg(F.count("*").alias("train_records"), F.count_if(F.col("class") == F.col("permuted")).alias("unchanged_by_chance"))
    summary = unchanged.agg(F.first(F.struct("train_records", "unchanged_by_chance")).alias("s"))
    return quality.select("*", summary.scalar().alias("_s")).select(
        F.col("_s.train_records").alias("train_records"),
        F.col("records").alias("validation_records"),
        F.col("_s.unchanged_by_chance").alias("unchanged_by_chance"),
        F.lit(1.0 / labels).alias("chance_accuracy"),
        "accuracy",
        "macro_f1",
        ((F.col("accuracy") < pass_below) & (F.col("macro_f1") < pass_below)).alias("passed"),
    )
