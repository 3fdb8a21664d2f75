"""Queries of classifier evaluation, ensembling, controls and run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriset.functions import vectors
from veriset.functions.names import hash60
from veriset.operators import checks, confusion, profile, ranking, resampling, runs, scores
from veriset.plans import derived, evaluation
from veriset.plans.catalog import query
from veriset.plans.derived import LABELS
from veriset.plans.report import control_report, metric_rows
from veriset.session import materialise
from veriset.plans.sql_parts import DOCS, EMB, HIST, RUNS, h60, improvements, predicted, probabilities, report

# --- predictions and confusion -------------------------------------------------------------

_PRED = f"{EMB}, {probabilities('a')}, {predicted('p_a')}"
_CELLS = "cells AS (SELECT true_index, predicted_index, count(*) AS n FROM pred GROUP BY 1, 2)"


def _predictions(spark, folder, model="a"):
    return scores.predictions(derived.scored(spark, folder, model))


@query(
    "predictions",
    f"""WITH {_PRED} SELECT id, true_index::BIGINT AS true_index, predicted_index::BIGINT AS predicted_index,
  round(confidence, 6) AS confidence, round(true_probability, 6) AS true_probability, correct FROM pred""",
)
def predictions(spark, folder):
    return _predictions(spark, folder).select("id", "true_index", "predicted_index", "confidence", "true_probability", "correct")


@query(
    "named_predictions",
    f"""WITH {_PRED} SELECT id, 'label_' || true_index AS true_class, 'label_' || predicted_index AS predicted_class, correct FROM pred""",
)
def named_predictions(spark, folder):
    labels = derived.table(spark, folder, "embeddings").select(
        F.col("label").alias("class_index"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("class_name")
    )
    named = scores.named_predictions(_predictions(spark, folder), labels.distinct())
    return named.select("id", "true_class", "predicted_class", "correct")


@query(
    "score_batches",
    f"""WITH {_PRED}, sq AS (SELECT id, sum(pow(p - CASE WHEN k = target THEN 1.0 ELSE 0.0 END, 2)) AS brier FROM p_a GROUP BY id)
SELECT id, predicted_index::BIGINT AS predicted_index, round(confidence, 6) AS confidence,
       round(-ln(least(greatest(true_probability, 1e-12), 1.0)), 6) AS log_loss, round(brier, 6) AS brier FROM pred JOIN sq USING (id)""",
)
def score_batches(spark, folder):
    features = derived.model_features(spark, folder, "a")
    scored = scores.centroid_scores(features, scores.centroids(features.filter("split = 'train'")))
    scored = confusion.row_losses(scored)
    return scores.predictions(scored).select("id", "predicted_index", "confidence", "log_loss", "brier")


@query(
    "blocked_predictions",
    f"WITH {_PRED} SELECT id, true_index::BIGINT AS true_index, predicted_index::BIGINT AS predicted_index, round(confidence, 6) AS confidence, round(true_probability, 6) AS true_probability FROM pred",
)
def blocked_predictions(spark, folder):
    features = derived.model_features(spark, folder, "a")
    fitted = scores.centroids(features.filter("split = 'train'"))
    found = scores.centroid_predictions(features, fitted, size=4)
    return found.select("id", "true_index", "predicted_index", "confidence", "true_probability")


@query("confusion", f"WITH {_PRED}, {_CELLS} SELECT true_index::BIGINT AS true_index, predicted_index::BIGINT AS predicted_index, n AS count FROM cells")
def confusion_cells(spark, folder):
    return confusion.cells(_predictions(spark, folder))


@query(
    "confusion_norm",
    f"""WITH {_PRED}, {_CELLS}, l AS (SELECT unnest(range(10)) AS k)
SELECT t.k AS true_index, p.k AS predicted_index, coalesce(n, 0) AS count,
       round(coalesce(n / nullif(sum(n) OVER (PARTITION BY t.k), 0), 0.0), 6) AS share
FROM l t CROSS JOIN l p LEFT JOIN cells c ON c.true_index = t.k AND c.predicted_index = p.k""",
)
def confusion_norm(spark, folder):
    return confusion.normalised_cells(confusion.dense_cells(confusion.cells(_predictions(spark, folder)), LABELS))


@query(
    "confusion_matrix",
    f"WITH {_PRED}, {_CELLS} SELECT 'label_' || k AS true_class, "
    + ", ".join(f"coalesce(sum(n) FILTER (WHERE predicted_index = {i}), 0)::BIGINT AS label_{i}" for i in range(LABELS))
    + " FROM (SELECT unnest(range(10)) AS k) l LEFT JOIN cells c ON c.true_index = l.k GROUP BY k",
)
def confusion_matrix(spark, folder):
    return confusion.confusion_matrix(confusion.cells(_predictions(spark, folder)), [f"label_{i}" for i in range(LABELS)])


@query(
    "top_confusions",
    f"""WITH {_PRED}, {_CELLS}, r AS (SELECT *, n / sum(n) OVER (PARTITION BY true_index) AS error_rate FROM cells)
SELECT true_index::BIGINT AS true_index, predicted_index::BIGINT AS predicted_index, n AS count, round(error_rate, 6) AS error_rate
FROM r WHERE true_index <> predicted_index ORDER BY n DESC, error_rate DESC, true_index, predicted_index LIMIT 20""",
)
def top_confusions(spark, folder):
    return confusion.top_confusions(confusion.cells(_predictions(spark, folder)), limit=20)


_REPORT_COLUMNS = """class_index, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  errors, round(errors / greatest(support, 1), 6) AS error_rate"""


@query("class_report", f"WITH {_PRED}, {_CELLS}, {report('cells', LABELS)} SELECT {_REPORT_COLUMNS} FROM rep")
def class_report(spark, folder):
    return confusion.class_report(confusion.cells(_predictions(spark, folder)), LABELS)


def _averages_sql(source: str = "rep", condition: str = "true") -> str:
    parts = [
        "sum(support)::BIGINT AS records, sum(errors)::BIGINT AS errors, round(sum(hits) / sum(support), 6) AS accuracy"
    ]
    for c in ("precision", "recall", "f1"):
        parts.append(f"round(avg({c}) FILTER (WHERE {condition}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}")
    return ", ".join(parts)


_POLICIES = {"all": "true", "observed": "support > 0 OR predicted > 0", "true_only": "support > 0"}


@query(
    "macro_weighted",
    f"WITH {_PRED}, {_CELLS}, {report('cells', LABELS + 2)} "
    + " UNION ALL ".join(f"SELECT '{name}' AS policy, {_averages_sql(condition=c)} FROM rep" for name, c in _POLICIES.items()),
)
def macro_weighted(spark, folder):
    """Two labels that never occur make the three averaging policies differ."""
    table = confusion.class_report(confusion.cells(_predictions(spark, folder)), LABELS + 2)
    rows = [confusion.averages(table, policy=p).withColumn("policy", F.lit(p)) for p in _POLICIES]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "confusion_scale",
    f"""WITH cells AS (SELECT l_linenumber - 1 AS true_index,
  {h60("l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber")} % 7 AS predicted_index, count(*) AS n FROM lineitem GROUP BY 1, 2),
{report('cells', 7)} SELECT {_REPORT_COLUMNS} FROM rep""",
)
def confusion_scale(spark, folder):
    colon = F.lit(":")
    guess = hash60(F.col("l_orderkey"), colon, F.col("l_partkey"), colon, F.col("l_suppkey"), colon, F.col("l_linenumber")) % 7
    judged = derived.table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("true_index"), guess.cast("int").alias("predicted_index")
    )
    return confusion.class_report(confusion.cells(judged), 7)


# --- probabilities -------------------------------------------------------------------------

_RANKED = """ranked AS (
  SELECT a.id, count(*) FILTER (WHERE b.p > a.p OR (b.p = a.p AND b.k < a.k)) AS before
  FROM p_a a JOIN p_a b ON b.id = a.id WHERE a.k = a.target GROUP BY a.id)"""


@query(
    "topk_accuracy",
    f"""WITH {_PRED}, {_RANKED} SELECT k, round(avg((before < k)::INTEGER), 6) AS accuracy
FROM ranked CROSS JOIN (SELECT unnest([1, 3, 5])::BIGINT AS k) GROUP BY k""",
)
def topk_accuracy(spark, folder):
    ranked = confusion.row_losses(derived.scored(spark, folder, "a"))
    levels = F.explode(F.array(*[F.lit(k) for k in (1, 3, 5)])).alias("k")
    return ranked.select("true_rank", levels).groupBy("k").agg(F.avg((F.col("true_rank") < F.col("k")).cast("double")).alias("accuracy"))


_BINS = """edges AS (SELECT i AS bin, CASE WHEN i = 15 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 15) END AS edge FROM (SELECT unnest(range(16)) AS i)),
bins AS (SELECT a.bin, a.edge AS lower, b.edge AS upper FROM edges a JOIN edges b ON b.bin = a.bin + 1),
cal AS (
  SELECT b.bin, lower, upper, count(id) AS count, avg(confidence) AS mean_confidence, avg(correct::INTEGER) AS accuracy,
         abs(avg(confidence) - avg(correct::INTEGER)) AS gap
  FROM bins b LEFT JOIN pred ON confidence >= lower AND (confidence < upper OR (b.bin = 14 AND confidence <= upper))
  GROUP BY b.bin, lower, upper)"""


@query(
    "calibration_bins",
    f"""WITH {_PRED}, {_BINS} SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count,
  round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM cal""",
)
def calibration_bins(spark, folder):
    return confusion.calibration_bins(_predictions(spark, folder))


@query(
    "ece_nll_brier",
    f"""WITH {_PRED}, {_BINS} SELECT (SELECT count(*) FROM pred) AS records,
  (SELECT round(sum(count * coalesce(gap, 0.0)) / sum(count), 6) FROM cal) AS ece,
  (SELECT round(avg(-ln(least(greatest(true_probability, 1e-12), 1.0))), 6) FROM pred) AS nll,
  (SELECT round(sum(pow(p - CASE WHEN k = target THEN 1.0 ELSE 0.0 END, 2)) / count(DISTINCT id), 6) FROM p_a) AS brier""",
)
def ece_nll_brier(spark, folder):
    scored = materialise(derived.scored(spark, folder, "a"))
    ece = confusion.expected_calibration_error(confusion.calibration_bins(scores.predictions(scored)))
    return confusion.probability_summary(scored).select("records", "nll", "brier", ece.scalar().alias("ece"))


# --- ranking -------------------------------------------------------------------------------

_AUC = """auc AS (
  SELECT a.k AS class_index, count(DISTINCT a.id) AS support, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS auc
  FROM p_a a JOIN p_a b ON b.k = a.k AND a.target = a.k AND b.target <> b.k GROUP BY a.k)"""


@query("auc_ovr", f"WITH {_PRED}, {_AUC} SELECT class_index::BIGINT AS class_index, support, round(auc, 6) AS auc FROM auc")
def auc_ovr(spark, folder):
    return ranking.auc_by_class(derived.scored(spark, folder, "a"), LABELS)


@query(
    "auc_averages",
    f"WITH {_PRED}, {_AUC} SELECT round(avg(auc), 6) AS macro_auc, round(sum(auc * support) / sum(support), 6) AS weighted_auc FROM auc",
)
def auc_averages(spark, folder):
    return ranking.auc_averages(ranking.auc_by_class(derived.scored(spark, folder, "a"), LABELS))


def _curve_sql(cls: str) -> str:
    """Corner points of the ROC curves of all classes, or of the pooled decisions."""
    return f"""sc AS (SELECT {cls} AS class_index, p AS score, count(*) FILTER (WHERE k = target) AS pos, count(*) FILTER (WHERE k <> target) AS neg FROM p_a GROUP BY 1, 2),
sw AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER (PARTITION BY class_index ORDER BY score DESC) AS rn,
         lead(pos) OVER (PARTITION BY class_index ORDER BY score DESC) AS npos, lead(neg) OVER (PARTITION BY class_index ORDER BY score DESC) AS nneg,
         sum(pos) OVER (PARTITION BY class_index) AS P, sum(neg) OVER (PARTITION BY class_index) AS N
  FROM sc WINDOW w AS (PARTITION BY class_index ORDER BY score DESC)),
pts AS (
  SELECT class_index, rn AS seq, (fp / N)::DOUBLE AS fpr, (tp / P)::DOUBLE AS tpr FROM sw
  WHERE NOT (rn > 1 AND npos IS NOT NULL AND npos = pos AND nneg = neg)
  UNION ALL SELECT DISTINCT class_index, 0, 0.0, 0.0 FROM sw)"""


_STEPS = """st AS (SELECT *, lead(fpr) OVER (PARTITION BY class_index ORDER BY seq) AS nf, lead(tpr) OVER (PARTITION BY class_index ORDER BY seq) AS nt FROM pts),
areas AS (SELECT class_index, sum((nf - fpr) * (nt + tpr) / 2) AS auc FROM st GROUP BY class_index)"""


@query("roc_points", f"WITH {_PRED}, {_curve_sql('k')} SELECT class_index::BIGINT AS class_index, seq, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts")
def roc_points(spark, folder):
    counts = ranking.score_counts(ranking.class_scores(derived.scored(spark, folder, "a")))
    return ranking.roc_points(counts).drop("score")


@query("roc_class_auc", f"WITH {_PRED}, {_curve_sql('k')}, {_STEPS} SELECT class_index::BIGINT AS class_index, round(auc, 6) AS auc FROM areas")
def roc_class_auc(spark, folder):
    counts = ranking.score_counts(ranking.class_scores(derived.scored(spark, folder, "a")))
    return ranking.curve_auc(ranking.roc_points(counts))


@query("roc_micro", f"WITH {_PRED}, {_curve_sql('-1')} SELECT seq, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts")
def roc_micro(spark, folder):
    counts = ranking.score_counts(ranking.pooled_scores(derived.scored(spark, folder, "a")))
    return ranking.roc_points(counts).select("seq", "fpr", "tpr")


@query("roc_micro_auc", f"WITH {_PRED}, {_curve_sql('-1')}, {_STEPS} SELECT round(auc, 6) AS auc FROM areas")
def roc_micro_auc(spark, folder):
    counts = ranking.score_counts(ranking.pooled_scores(derived.scored(spark, folder, "a")))
    return ranking.curve_auc(ranking.roc_points(counts)).select("auc")


_MACRO = f"""{_curve_sql('k')},
ends AS (SELECT class_index, fpr, max(tpr) AS top, min(tpr) AS bottom FROM pts GROUP BY 1, 2),
seg AS (SELECT *, lead(fpr) OVER (PARTITION BY class_index ORDER BY fpr) AS nf, lead(bottom) OVER (PARTITION BY class_index ORDER BY fpr) AS nb FROM ends),
macro AS (
  SELECT g.fpr, sum(CASE WHEN nf IS NULL OR g.fpr = s.fpr THEN top ELSE top + (nb - top) * (g.fpr - s.fpr) / (nf - s.fpr) END) / 10 AS tpr
  FROM (SELECT DISTINCT fpr FROM pts) g JOIN seg s ON g.fpr >= s.fpr AND (g.fpr < s.nf OR s.nf IS NULL) GROUP BY g.fpr)"""


@query("roc_macro", f"WITH {_PRED}, {_MACRO} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM macro")
def roc_macro(spark, folder):
    counts = ranking.score_counts(ranking.class_scores(derived.scored(spark, folder, "a")))
    return ranking.macro_curve(ranking.roc_points(counts), LABELS)


@query(
    "roc_macro_auc",
    f"""WITH {_PRED}, {_MACRO} SELECT round(sum((nf - fpr) * (nt + tpr) / 2), 6) AS auc
FROM (SELECT *, lead(fpr) OVER (ORDER BY fpr) AS nf, lead(tpr) OVER (ORDER BY fpr) AS nt FROM macro)""",
)
def roc_macro_auc(spark, folder):
    counts = ranking.score_counts(ranking.class_scores(derived.scored(spark, folder, "a")))
    return ranking.macro_curve_auc(ranking.macro_curve(ranking.roc_points(counts), LABELS))


# --- resampling ----------------------------------------------------------------------------

_REPLICATES = 1000
_UNIT = "({} + 0.5::DOUBLE) / 1152921504606846976::DOUBLE"
_DRAWN = "len(list_filter(c, lambda x: x < u))"
_POISSON = f"""counted AS (SELECT true_index, predicted_index, count(*) AS m FROM pred GROUP BY 1, 2),
below AS (SELECT m, list(c ORDER BY k) AS c FROM (
  SELECT m, k, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS c
  FROM (SELECT m, unnest(range(0, ceil(m + 12 * sqrt(m) + 41)::BIGINT)) AS k FROM (SELECT DISTINCT m FROM counted))) GROUP BY m),
draws AS (SELECT *, {_UNIT.format(h60("'poisson:' || replicate || ':' || true_index || ':' || predicted_index"))} AS u
  FROM counted CROSS JOIN (SELECT unnest(range({_REPLICATES})) AS replicate)),
cells AS (SELECT * FROM (SELECT replicate, true_index, predicted_index, {_DRAWN} AS n FROM draws JOIN below USING (m)) WHERE n > 0),
{report('cells', LABELS, keys='replicate')},
reps AS (SELECT replicate, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM rep GROUP BY replicate)"""


@query(
    "bootstrap_poisson",
    f"WITH {_PRED}, {_POISSON} SELECT replicate, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM reps",
)
def bootstrap_poisson(spark, folder):
    return resampling.poisson_replicates(_predictions(spark, folder), LABELS, _REPLICATES)


@query(
    "bootstrap_poisson_ci",
    f"WITH {_PRED}, {_POISSON} SELECT count(*) AS samples, "
    + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.025), 6) AS {c}_ci_low, round(quantile_cont({c}, 0.975), 6) AS {c}_ci_high"
        for c in ("accuracy", "macro_f1")
    )
    + " FROM reps",
)
def bootstrap_poisson_ci(spark, folder):
    return resampling.intervals(resampling.poisson_replicates(_predictions(spark, folder), LABELS, _REPLICATES))


def _splits_sql(bits: int) -> str:
    """Counts of the two halves of every node, one level after the other, from the distribution of the binomial draws."""
    levels = ["t0 AS (SELECT model, replicate, 0::BIGINT AS node, sum(n)::BIGINT AS n FROM leaves CROSS JOIN (SELECT unnest(range(1000)) AS replicate) GROUP BY model, replicate)"]
    for depth in range(bits):
        shift = bits - depth - 1
        levels.append(f"""w{depth} AS (SELECT model, node >> {shift + 1} AS node, coalesce(sum(n) FILTER (WHERE (node >> {shift}) % 2 = 0), 0)::BIGINT AS wl, sum(n)::BIGINT AS w FROM leaves GROUP BY ALL),
q{depth} AS (SELECT t.*, wl, w, {_UNIT.format(h60(f"'7:' || replicate || ':{depth}:' || node"))} AS u FROM t{depth} t JOIN w{depth} USING (model, node) WHERE n > 0),
b{depth} AS (SELECT n, wl, w, list(c ORDER BY k) AS c FROM (
  SELECT n, wl, w, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(wl / w) + (n - k) * ln(1 - wl / w))) OVER (PARTITION BY n, wl, w ORDER BY k) AS c
  FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT DISTINCT n, wl, w FROM q{depth} WHERE wl > 0 AND wl < w))) GROUP BY n, wl, w),
l{depth} AS (SELECT model, replicate, node, n, CASE WHEN wl = 0 THEN 0 WHEN wl = w THEN n ELSE least(n, {_DRAWN}) END AS left_n FROM q{depth} LEFT JOIN b{depth} USING (n, wl, w)),
t{depth + 1} AS (SELECT model, replicate, 2 * node AS node, left_n AS n FROM l{depth} UNION ALL SELECT model, replicate, 2 * node + 1, n - left_n FROM l{depth})""")
    return ",\n".join(levels)


_MEASURES = [f"{how}({c}{rest}), 6) AS {c}_{name}" for c in ("accuracy", "macro_f1") for how, rest, name in (("round(avg", "", "mean"), ("round(quantile_cont", ", 0.025", "ci_low"), ("round(quantile_cont", ", 0.975", "ci_high"))]


@query(
    "bootstrap_multinomial",
    f"""WITH {EMB}, {probabilities('a')}, {probabilities('b')}, {predicted('p_a', 'pred_a')}, {predicted('p_b', 'pred_b')},
points AS (SELECT 'a' AS model, true_index, predicted_index, count(*) AS n FROM pred_a GROUP BY 2, 3 UNION ALL SELECT 'b', true_index, predicted_index, count(*) FROM pred_b GROUP BY 2, 3),
{report('points', LABELS, 'prep', 'model')},
point AS (SELECT model, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM prep GROUP BY model),
leaves AS (SELECT model, (true_index * {LABELS} + predicted_index)::BIGINT AS node, n FROM points),
{_splits_sql((LABELS * LABELS - 1).bit_length())},
drawn AS (SELECT model, replicate, node // {LABELS} AS true_index, node % {LABELS} AS predicted_index, n FROM t{(LABELS * LABELS - 1).bit_length()} WHERE n > 0),
{report('drawn', LABELS, 'drep', 'model, replicate')},
reps AS (SELECT model, replicate, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM drep GROUP BY model, replicate),
found AS (SELECT model, count(*) AS samples, {", ".join(_MEASURES)} FROM reps GROUP BY model)
SELECT * FROM found JOIN point USING (model)""",
)
def bootstrap_multinomial(spark, folder):
    models = [
        confusion.cells(_predictions(spark, folder, m).withColumn("model", F.lit(m)), ["model"]) for m in ("a", "b")
    ]
    both = materialise(models[0].unionByName(models[1]))
    found = resampling.intervals(resampling.multinomial_replicates(both, LABELS), ["model"])
    return found.join(confusion.averages(confusion.class_report(both, LABELS, ["model"]), ["model"]).select("model", "accuracy", "macro_f1"), "model")


# --- ensembles -----------------------------------------------------------------------------

_BOTH = f"{EMB}, {probabilities('a')}, {probabilities('b')}"
_SEARCH = f"""mix AS (
  SELECT w, a.id, a.target, a.split, a.k, (1 - w) * a.p + w * b.p AS p
  FROM p_a a JOIN p_b b ON b.id = a.id AND b.k = a.k CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)),
val AS (SELECT * FROM mix WHERE split = 'validation'),
vp AS (SELECT w, id, target AS true_index, arg_min(k, (-p, k)) AS predicted_index,
         -ln(least(greatest(max(p) FILTER (WHERE k = target), 1e-12), 1.0)) AS loss FROM val GROUP BY w, id, target),
vcells AS (SELECT w, true_index, predicted_index, count(*) AS n FROM vp GROUP BY 1, 2, 3),
{report('vcells', LABELS, 'vrep', 'w')},
table_ AS (SELECT v.w, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, any_value(l.loss) AS loss, v.w IN (0.25, 0.5, 0.75) AS eligible
  FROM vrep v JOIN (SELECT w, avg(loss) AS loss FROM vp GROUP BY w) l ON l.w = v.w GROUP BY v.w),
best AS (SELECT w FROM table_ WHERE eligible ORDER BY macro_f1 DESC, loss, w LIMIT 1)"""


def _validation(spark, folder, model):
    return derived.scored(spark, folder, model).filter("split = 'validation'").drop("split")


@query(
    "weight_search",
    f"""WITH {_BOTH}, {_SEARCH} SELECT w AS second_weight, 1 - w AS first_weight, eligible, round(loss, 6) AS validation_loss,
  round(accuracy, 6) AS validation_accuracy, round(macro_f1, 6) AS validation_macro_f1, w = (SELECT w FROM best) AS chosen FROM table_""",
)
def weight_search(spark, folder):
    return scores.weight_search(_validation(spark, folder, "a"), _validation(spark, folder, "b"), LABELS)


@query(
    "ensemble_metrics",
    f"""WITH {_BOTH}, {_SEARCH},
tp AS (SELECT id, target AS true_index, arg_min(k, (-p, k)) AS predicted_index FROM mix WHERE split = 'test' AND w = (SELECT w FROM best) GROUP BY id, target),
cells AS (SELECT true_index, predicted_index, count(*) AS n FROM tp GROUP BY 1, 2), {report('cells', LABELS)}
SELECT {_averages_sql()} FROM rep""",
)
def ensemble_metrics(spark, folder):
    """The weight is chosen on validation records and applied to the test records."""
    scored = [materialise(derived.scored(spark, folder, m)) for m in ("a", "b")]
    validation, test = ([s.filter(F.col("split") == part).drop("split") for s in scored] for part in ("validation", "test"))
    voted = scores.chosen_vote(*test, scores.weight_search(*validation, LABELS))
    return confusion.averages(confusion.class_report(confusion.cells(scores.predictions(voted)), LABELS))


@query(
    "evaluation_summary",
    f"""WITH {_PRED}, {_CELLS}, {report('cells', LABELS)}, {_RANKED}, {_BINS}, {_AUC}
SELECT {_averages_sql()},
  (SELECT round(avg(-ln(least(greatest(true_probability, 1e-12), 1.0))), 6) FROM pred) AS nll,
  (SELECT round(sum(pow(p - CASE WHEN k = target THEN 1.0 ELSE 0.0 END, 2)) / count(DISTINCT id), 6) FROM p_a) AS brier,
  (SELECT round(avg((before < 3)::INTEGER), 6) FROM ranked) AS top3_accuracy,
  (SELECT round(avg(auc), 6) FROM auc) AS macro_auc, (SELECT round(sum(auc * support) / sum(support), 6) FROM auc) AS weighted_auc,
  (SELECT round(sum(count * coalesce(gap, 0.0)) / sum(count), 6) FROM cal) AS ece FROM rep""",
)
def evaluation_summary(spark, folder):
    return evaluation.summary_row(materialise(derived.scored(spark, folder, "a")), LABELS)


# --- foreign labels, conditions, controls --------------------------------------------------

_MAPPED = f"""{_PRED}, mapped AS (
  SELECT id, 'src_' || true_index AS source_class, 'label_' || (true_index % 6) AS target_class, true_index % 6 AS target, predicted_index FROM pred)"""


def _mapping(spark, folder):
    """Ten foreign names onto six labels, plus two names without a folder."""
    names = spark.range(12).select(
        F.concat(F.lit("src_"), F.col("id").cast("string")).alias("source_class"),
        F.concat(F.lit("label_"), (F.col("id") % 6).cast("string")).alias("target_class"),
    )
    classes = derived.table(spark, folder, "embeddings").select(
        F.col("label").alias("class_index"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("class_name")
    ).distinct()
    return names, classes


def _foreign(spark, folder):
    mapping, classes = _mapping(spark, folder)
    scored = derived.scored(spark, folder, "a").withColumn("source_class", F.concat(F.lit("src_"), F.col("target").cast("string")))
    mapped = confusion.mapped_targets(scored.drop("target"), mapping, classes)
    return scores.predictions(mapped)


@query(
    "ood_report",
    f"""WITH {_MAPPED} SELECT source_class, target_class, count(*) AS support, round(avg((target = predicted_index)::INTEGER), 6) AS accuracy,
  count(*) FILTER (WHERE target <> predicted_index) AS errors FROM mapped GROUP BY 1, 2""",
)
def ood_report(spark, folder):
    return confusion.source_report(_foreign(spark, folder))


@query(
    "ood_summary",
    f"""WITH {_MAPPED}, cells AS (SELECT target AS true_index, predicted_index, count(*) AS n FROM mapped GROUP BY 1, 2), {report('cells', LABELS)}
SELECT {_averages_sql(condition='support > 0')} FROM rep""",
)
def ood_summary(spark, folder):
    report_table = confusion.class_report(confusion.cells(_foreign(spark, folder)), LABELS)
    return confusion.averages(report_table, policy="true_only")


@query(
    "label_mapping",
    """SELECT 'src_' || i AS source_class, 'label_' || (i % 6) AS target_class, count(label) > 0 AS present, count(label) AS records
FROM (SELECT unnest(range(12)) AS i) m LEFT JOIN embeddings ON label = i GROUP BY i""",
)
def label_mapping(spark, folder):
    mapping, _ = _mapping(spark, folder)
    found = derived.embeddings(spark, folder).select(F.concat(F.lit("src_"), F.col("target").cast("string")).alias("source_class"))
    return confusion.mapping_coverage(mapping, found)


_CONDITION_SQL = {
    "clean": "embedding",
    "brightness_1.40": "list_transform(embedding, lambda x: x * 1.4)",
    "contrast_0.60": "list_transform(embedding, lambda x: list_avg(embedding) + (x - list_avg(embedding)) * 0.6)",
    "centre_occluded": "list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 8 BETWEEN 2 AND 6 AND (i - 1) // 8 BETWEEN 2 AND 6 THEN 0.0 ELSE x END)",
    "border_occluded": "list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 8 BETWEEN 2 AND 5 AND (i - 1) // 8 BETWEEN 2 AND 5 THEN x ELSE 0.0 END)",
}


def _conditions():
    def mean(px):
        return F.aggregate(px, F.lit(0.0), lambda t, x: t + x) / F.size(px)

    return {
        "clean": lambda px: px,
        "brightness_1.40": lambda px: vectors.brightness(px, 1.4, limits=None),
        "contrast_0.60": lambda px: vectors.contrast(px, 0.6, mean(px), limits=None),
        "centre_occluded": lambda px: vectors.occlude_centre(px, 8, 8, fill=0.0),
        "border_occluded": lambda px: vectors.occlude_border(px, 8, 8, fill=0.0),
    }


_SWEEP = (
    f"{EMB}, stressed AS ("
    + " UNION ALL ".join(f"SELECT id, target, split, '{n}' AS condition, {e} AS v FROM emb" for n, e in _CONDITION_SQL.items())
    + ")"
    + "".join(
        f", {probabilities(m, source='stressed', features='v', fit_on=fit, extra='condition')}, {predicted(f'p_{m}', f'pred_{m}', 'condition')}"
        for m, fit in (("t", "split = 'train' AND condition = 'clean'"), ("u", "condition = 'clean'"))
    )
    + """, both_ AS (SELECT 'train_fit' AS model, condition, true_index, predicted_index FROM pred_t
  UNION ALL SELECT 'full_fit', condition, true_index, predicted_index FROM pred_u),
cells AS (SELECT condition, model, true_index, predicted_index, count(*) AS n FROM both_ GROUP BY ALL),
"""
    + report("cells", LABELS, keys="condition, model")
    + """, q AS (SELECT condition, model, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(errors)::BIGINT AS errors FROM rep GROUP BY 1, 2)
SELECT q.condition, q.model, round(q.accuracy, 6) AS accuracy, round(q.macro_f1, 6) AS macro_f1, q.errors,
       round((c.accuracy - q.accuracy) * 100, 6) + 0.0 AS accuracy_drop_pp
FROM q JOIN q c ON c.model = q.model AND c.condition = 'clean'"""
)


@query("condition_sweep", f"WITH {_SWEEP}")
def condition_sweep(spark, folder):
    features = derived.embeddings(spark, folder).withColumn("features", F.col("embedding").cast("array<double>")).drop("embedding")
    stressed = scores.under_conditions(features, _conditions())
    judged = []
    for model, fit_on in (("train_fit", features.filter("split = 'train'")), ("full_fit", features)):
        scored = scores.centroid_scores(stressed, scores.centroids(fit_on))
        judged.append(scores.predictions(scored).withColumn("model", F.lit(model)))
    columns = ["condition", "model", "true_index", "predicted_index"]
    return confusion.condition_sweep(judged[0].select(columns).unionByName(judged[1].select(columns)), LABELS)


_TRAIN_PER_CLASS = 20


def _control_features(spark, folder):
    return derived.embeddings(spark, folder).select(
        "id", F.col("target").alias("class"), "split", F.col("embedding").cast("array<double>").alias("features")
    )


def _centroid_fit(train, validation):
    return scores.centroid_scores(validation, scores.centroids(train))


_CONTROL = f"""{EMB},
trn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h60("'sample:42:' || id")}, id) AS rn FROM emb WHERE split = 'train') WHERE rn <= {_TRAIN_PER_CLASS}),
vld AS (SELECT * FROM emb WHERE split = 'validation'),
slots AS (SELECT id, target, row_number() OVER (ORDER BY {h60("'slot:42:' || id")}, id) AS r FROM trn),
drawn AS (SELECT target AS permuted, row_number() OVER (ORDER BY {h60("'label:42:' || id")}, id) AS r FROM trn),
perm AS (SELECT id, target, permuted FROM slots JOIN drawn USING (r)),
ctl AS (SELECT t.id, t.target, t.split, p.permuted, t.embedding FROM trn t JOIN perm p USING (id)
  UNION ALL SELECT id, target, split, NULL, embedding FROM vld),
{probabilities('x', source='ctl', features='embedding', fit_on="split = 'train'", fit_label='permuted', extra='permuted')},
vonly AS (SELECT * FROM p_x WHERE split = 'validation'), {predicted('vonly', 'vpred')},
cells AS (SELECT true_index, predicted_index, count(*) AS n FROM vpred GROUP BY 1, 2), {report('cells', LABELS)},
q AS (SELECT sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM rep)
SELECT (SELECT count(*) FROM perm) AS train_records, n AS validation_records,
       (SELECT count(*) FROM perm WHERE target = permuted) AS unchanged_by_chance, 0.1::DOUBLE AS chance_accuracy,
       round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, accuracy < 0.10 AND macro_f1 < 0.10 AS passed FROM q"""


@query("permutation_control", f"WITH {_CONTROL}")
def permutation_control(spark, folder):
    return scores.permutation_control(
        _control_features(spark, folder), LABELS, _TRAIN_PER_CLASS, _centroid_fit
    )


@query(
    "permutation_control_head",
    f"WITH {_CONTROL.rpartition('SELECT (SELECT')[0]} SELECT (SELECT count(*) FROM perm) AS train_records, n AS validation_records, "
    "(SELECT count(*) FROM perm WHERE target = permuted) AS unchanged_by_chance, 0.1::DOUBLE AS chance_accuracy, true AS plausible FROM q",
)
def permutation_control_head(spark, folder):
    def fit(train, validation):
        return scores.linear_scores(validation, scores.linear_head(train))

    found = scores.permutation_control(_control_features(spark, folder), LABELS, _TRAIN_PER_CLASS, fit)
    # The fit is iterative, so SQL checks the counts and that the accuracy is near chance.
    return found.select("train_records", "validation_records", "unchanged_by_chance", "chance_accuracy", (F.col("accuracy") < 0.4).alias("plausible"))


@query(
    "prediction_coverage",
    f"""WITH {_PRED}, v AS (SELECT count(*) AS violations FROM (SELECT id, count(*) AS n FROM pred GROUP BY id) p
  FULL JOIN (SELECT id, count(*) AS n FROM emb GROUP BY id) m ON m.id = p.id WHERE p.n IS DISTINCT FROM 1 OR m.n IS DISTINCT FROM 1)
SELECT 'predictions_cover_manifest' AS "check", violations, violations = 0 AS passed FROM v""",
)
def prediction_coverage(spark, folder):
    found = checks.unpaired(_predictions(spark, folder), derived.embeddings(spark, folder))
    return checks.check("predictions_cover_manifest", found)


@query(
    "error_examples",
    f"""WITH {_PRED} SELECT id, true_index::BIGINT AS true_index, predicted_index::BIGINT AS predicted_index, round(confidence, 6) AS confidence
FROM pred WHERE NOT correct ORDER BY confidence DESC, id LIMIT 48""",
)
def error_examples(spark, folder):
    return runs.most_confident(_predictions(spark, folder), False, 48).select("id", "true_index", "predicted_index", "confidence")


def _diverse_sql(condition: str, keys: str) -> str:
    return f"""(SELECT id, correct, rn = 1 AS first_of_kind FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS rn FROM pred WHERE {condition}) ORDER BY rn = 1 DESC, id LIMIT 60)"""


@query(
    "diverse_examples",
    f"""WITH {_PRED} SELECT * FROM {_diverse_sql('correct', 'true_index')} UNION ALL
SELECT * FROM {_diverse_sql('NOT correct', 'true_index, predicted_index')}""",
)
def diverse_examples(spark, folder):
    predicted_rows = materialise(_predictions(spark, folder).drop("probs"))
    picked = [runs.diverse_examples(predicted_rows, 60, correct).select("id", "correct", "first_of_kind") for correct in (True, False)]
    return picked[0].unionByName(picked[1])


# --- runs ----------------------------------------------------------------------------------


@query(
    "improvement_chain",
    f"""WITH RECURSIVE {HIST}, {improvements()}
SELECT run, row_number() OVER (PARTITION BY run ORDER BY position) AS step, best_epoch AS epoch, position, best_f1 AS f1, best_loss AS loss, epochs
FROM fold WHERE position = best_position""",
)
def improvement_chain(spark, folder):
    return runs.improvement_chain(derived.history(spark, folder))


@query(
    "best_epoch",
    f"WITH RECURSIVE {HIST}, {improvements()} SELECT run, best_epoch, best_f1, best_loss, epochs FROM fold WHERE position = epochs",
)
def best_epoch(spark, folder):
    return runs.best_epoch(runs.improvement_chain(derived.history(spark, folder)))


@query(
    "early_stop",
    f"""WITH RECURSIVE {HIST}, {improvements()},
stops AS (SELECT run, min(position) FILTER (WHERE position - best_position >= 5) AS stop, max(epochs) AS epochs FROM fold GROUP BY run)
SELECT s.run, f.best_epoch, f.best_f1, coalesce(stop, s.epochs) AS effective_epochs, stop IS NOT NULL AS stopped_early
FROM stops s JOIN fold f ON f.run = s.run AND f.position = coalesce(stop, s.epochs)""",
)
def early_stop(spark, folder):
    return runs.early_stop(runs.improvement_chain(derived.history(spark, folder)), 5)


@query(
    "best_and_last",
    f"""WITH {HIST} SELECT run, arg_max(epoch, (f1, -epoch)) AS best_epoch, arg_max(f1, (f1, -epoch)) AS best_f1, arg_max(loss, (f1, -epoch)) AS best_loss,
  max(epoch) AS epochs_completed, arg_max(f1, epoch) AS final_f1, arg_max(loss, epoch) AS final_loss FROM hist GROUP BY run""",
)
def best_and_last(spark, folder):
    return runs.best_and_last(derived.history(spark, folder))


_TOTALS = """tot AS (SELECT run, sum(elapsed_seconds) / 60 AS training_minutes, max(peak_memory_mb) AS peak_memory_mb, count(*) AS epochs_completed,
  max(epoch) AS last_epoch FROM hist GROUP BY run)"""


@query(
    "history_totals",
    f"WITH {HIST}, {_TOTALS} SELECT run, round(training_minutes, 6) AS training_minutes, peak_memory_mb, epochs_completed, last_epoch FROM tot",
)
def history_totals(spark, folder):
    return runs.history_totals(derived.history(spark, folder))


@query(
    "metric_curves",
    f"""WITH {HIST} SELECT run, epoch, 'f1' AS metric, f1 AS value FROM hist UNION ALL SELECT run, epoch, 'loss', round(loss, 6) FROM hist""",
)
def metric_curves(spark, folder):
    return runs.metric_curves(derived.history(spark, folder), ["f1", "loss"])


_COMPARISON = f"""{HIST}, {RUNS}, {_TOTALS}, cmp AS (
  SELECT t.run, coalesce(total_parameters, trainable_parameters) AS parameters, epochs_completed, training_minutes, test_accuracy, test_macro_f1, test_examples,
         coalesce(errors, test_errors, round_even((1.0 - test_accuracy) * test_examples, 0)::BIGINT) AS errors
  FROM cfg JOIN tot t ON t.run = cfg.run JOIN summ s ON s.run = cfg.run)"""


def _comparison(spark, folder):
    return runs.comparison_table(
        runs.assemble_runs(
            derived.run_config(spark, folder), runs.history_totals(derived.history(spark, folder)), derived.run_summary(spark, folder)
        )
    )


@query(
    "run_comparison",
    f"""WITH {_COMPARISON} SELECT run, parameters, round(parameters / 1e6, 6) AS parameters_million, round(parameters * 4.0::DOUBLE / 1048576, 6) AS fp32_size_mb,
  epochs_completed, round(training_minutes, 6) AS training_minutes, round(test_accuracy, 6) AS test_accuracy, test_macro_f1, test_examples, errors FROM cmp""",
)
def run_comparison(spark, folder):
    return _comparison(spark, folder)


@query(
    "run_size_differences",
    f"WITH {_COMPARISON} SELECT run, test_examples FROM cmp WHERE test_examples <> (SELECT min(test_examples) FROM cmp)",
)
def run_size_differences(spark, folder):
    return runs.different_sizes(_comparison(spark, folder)).select("run", "test_examples")


@query(
    "missing_parts",
    " UNION ALL ".join(
        f"SELECT c_custkey AS run, '{part}' AS part FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"
        for part in ("config", "history", "summary")
    ),
)
def missing_parts(spark, folder):
    expected = derived.table(spark, folder, "customer").select(F.col("c_custkey").alias("run"))
    return runs.missing_parts(
        expected,
        {
            "config": derived.run_config(spark, folder),
            "history": derived.history(spark, folder),
            "summary": derived.run_summary(spark, folder),
        },
    )


@query(
    "winner_ratio",
    f"""WITH {_COMPARISON} SELECT (SELECT run FROM cmp ORDER BY test_macro_f1 DESC, run LIMIT 1) AS winner, max(test_macro_f1) AS winner_macro_f1,
  round(1.0 - max(parameters) FILTER (WHERE run = 2) / max(parameters) FILTER (WHERE run = 1), 6) AS parameter_reduction FROM cmp""",
)
def winner_ratio(spark, folder):
    return runs.winner_and_reduction(_comparison(spark, folder), 1, 2)


_SEEDS = " UNION ALL ".join(
    f"""SELECT seed, '{m}' AS metric, count({m}) AS runs, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min,
  round(max({m}), 6) AS max, round((max({m}) - min({m})) * 100, 6) AS range_pp FROM cfg JOIN summ ON summ.run = cfg.run GROUP BY seed"""
    for m in ("test_accuracy", "test_macro_f1")
)


def _stability(spark, folder):
    both = derived.run_config(spark, folder).join(derived.run_summary(spark, folder), "run")
    return runs.seed_stability(both, ["test_accuracy", "test_macro_f1"], ["seed"])


@query("seed_stability", f"WITH {RUNS} {_SEEDS}")
def seed_stability(spark, folder):
    return _stability(spark, folder)


@query(
    "gap",
    f"""WITH RECURSIVE {HIST}, {RUNS}, {improvements()}, chosen AS (SELECT run, best_epoch FROM fold WHERE position = epochs)
SELECT h.run, h.epoch AS best_epoch, train_accuracy, train_eval_accuracy, validation_accuracy, round(test_accuracy, 6) AS test_accuracy,
  round((train_eval_accuracy - validation_accuracy) * 100, 6) + 0.0 AS clean_train_minus_validation_pp,
  round((validation_accuracy - test_accuracy) * 100, 6) + 0.0 AS validation_minus_test_pp,
  round(train_eval_macro_f1 - f1, 6) + 0.0 AS clean_train_minus_validation_macro_f1,
  round(f1 - test_macro_f1, 6) + 0.0 AS validation_minus_test_macro_f1
FROM chosen c JOIN hist h ON h.run = c.run AND h.epoch = c.best_epoch JOIN summ s ON s.run = h.run""",
)
def gap(spark, folder):
    history = derived.history(spark, folder)
    best = runs.best_epoch(runs.improvement_chain(history))
    at_best = runs.at_best_epoch(history.withColumnRenamed("f1", "validation_macro_f1"), best)
    return runs.generalization_gap(at_best, derived.run_summary(spark, folder))


# --- report --------------------------------------------------------------------------------

_SECTIONS = ("split_integrity", "quality", "seed_stability", "robustness", "random_label")


@query(
    "control_report",
    f"""WITH {DOCS}, {_PRED}, {_CELLS}, {report('cells', LABELS)}, {RUNS}, seeds AS ({_SEEDS}),
q AS (SELECT sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM rep),
rows_ AS (
  SELECT 'split_integrity' AS section, split AS subject, 'records' AS metric, count(*)::DOUBLE AS value FROM docs GROUP BY split
  UNION ALL SELECT 'quality', 'all', 'accuracy', round(accuracy, 6) FROM q UNION ALL SELECT 'quality', 'all', 'macro_f1', round(macro_f1, 6) FROM q
  UNION ALL SELECT 'seed_stability', metric || '/' || seed, 'mean', mean FROM seeds
  UNION ALL SELECT 'seed_stability', metric || '/' || seed, 'std', std FROM seeds)
SELECT s.section, subject, metric, value, CASE WHEN metric IS NULL THEN 'PENDING' ELSE 'DONE' END AS status
FROM (SELECT unnest({list(_SECTIONS)}) AS section) s LEFT JOIN rows_ r ON r.section = s.section""",
)
def control_report_query(spark, folder):
    quality = confusion.averages(confusion.class_report(confusion.cells(_predictions(spark, folder)), LABELS))
    stability = _stability(spark, folder).withColumn("subject", F.concat_ws("/", "metric", F.col("seed").cast("string")))
    expected = spark.createDataFrame([(s,) for s in _SECTIONS], "section string")
    return control_report(
        expected,
        [
            metric_rows("split_integrity", profile.split_counts(derived.documents(spark, folder)), ["records"], "split"),
            metric_rows("quality", quality, ["accuracy", "macro_f1"]),
            metric_rows("seed_stability", stability, ["mean", "std"], "subject"),
        ],
    )
