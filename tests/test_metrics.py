"""Metrics against published values and against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import golden
from veriset.operators import confusion, ranking, resampling, scores
from veriset.plans import evaluation


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(golden.CELLS, "true_index int, predicted_index int, count bigint")


def test_published_confusion_matrix_gives_the_published_metrics(cells):
    row = confusion.averages(confusion.class_report(cells, 38)).first()
    assert row.records == 10709 and row.errors == golden.ERRORS
    for name, value in golden.QUALITY.items():
        assert row[name] == pytest.approx(value, abs=1e-9)


def test_published_bins_give_the_published_calibration_error(spark):
    bins = spark.createDataFrame(golden.BINS, "bin int, count bigint, gap double")
    assert confusion.expected_calibration_error(bins).first().ece == pytest.approx(golden.ECE, abs=1e-9)


def test_bootstrap_interval_matches_the_published_one(cells):
    replicates = resampling.multinomial_replicates(cells.withColumn("model", F.lit("m")), 38, 400)
    row = resampling.intervals(replicates, ["model"]).first()
    assert row.samples == 400
    assert row.accuracy_ci_low == pytest.approx(golden.ACCURACY_CI[0], abs=4e-4)
    assert row.accuracy_ci_high == pytest.approx(golden.ACCURACY_CI[1], abs=4e-4)
    again = resampling.multinomial_replicates(cells.withColumn("model", F.lit("m")).repartition(3), 38, 400)
    assert resampling.intervals(again, ["model"]).first() == row


def test_label_policies(spark):
    # class 2 is predicted only, class 3 never occurs
    cells = spark.createDataFrame([(0, 0, 4), (0, 2, 1), (1, 1, 5)], "true_index int, predicted_index int, count bigint")
    report = confusion.class_report(cells, 4)
    f1 = {r.class_index: r.f1 for r in report.collect()}
    assert f1 == {0: pytest.approx(8 / 9), 1: 1.0, 2: 0.0, 3: 0.0}
    total = 8 / 9 + 1
    values = {p: confusion.averages(report, policy=p).first().macro_f1 for p in ("all", "observed", "true_only")}
    assert values == {"all": pytest.approx(total / 4), "observed": pytest.approx(total / 3), "true_only": pytest.approx(total / 2)}


def test_dense_cells_and_top_confusions(spark, cells):
    dense = confusion.normalised_cells(confusion.dense_cells(cells, 39))
    assert dense.count() == 39 * 39 and dense.agg(F.sum("count")).first()[0] == 10709
    assert dense.filter("true_index = 38").agg(F.max("share")).first()[0] == 0.0
    top = confusion.top_confusions(cells, limit=2).collect()
    assert [(r.true_index, r.predicted_index, r["count"]) for r in top] == [(32, 30, 17), (29, 30, 11)]
    assert top[0].error_rate == pytest.approx(17 / 337)


def scored_frame(spark, n=240, labels=4, seed=3, grain=8):
    """Coarse probabilities, so that ties are common."""
    rng = np.random.default_rng(seed)
    probs = rng.integers(1, grain, size=(n, labels)).astype(float)
    probs /= probs.sum(axis=1, keepdims=True)
    target = rng.integers(0, labels, size=n)
    rows = [(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(target, probs))]
    return target, probs, spark.createDataFrame(rows, "id bigint, target int, probs array<double>")


def rank_auc(target, score):
    pos, neg = score[target], score[~target]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def roc_corners(target, score):
    order = np.unique(score)[::-1]
    pos = np.array([(score[target] == s).sum() for s in order])
    neg = np.array([(score[~target] == s).sum() for s in order])
    keep = [i for i in range(len(order)) if i in (0, len(order) - 1) or pos[i] != pos[i + 1] or neg[i] != neg[i + 1]]
    tpr, fpr = np.cumsum(pos) / pos.sum(), np.cumsum(neg) / neg.sum()
    return np.r_[0, fpr[keep]], np.r_[0, tpr[keep]]


@pytest.mark.parametrize("partitions", [1, 5])
def test_auc_with_ties_equals_pair_counting(spark, partitions):
    target, probs, df = scored_frame(spark)
    found = {r.class_index: r.auc for r in ranking.auc_by_class(df.repartition(partitions), 4).collect()}
    for k in range(4):
        assert found[k] == pytest.approx(rank_auc(target == k, probs[:, k]))


def test_auc_is_null_without_positives(spark):
    _, _, df = scored_frame(spark)
    by_class = ranking.auc_by_class(df.withColumn("probs", F.concat("probs", F.array(F.lit(0.0)))), 5)
    assert by_class.filter("class_index = 4").first().auc is None
    assert ranking.auc_averages(by_class).first().macro_auc is None


def test_roc_curves_equal_direct_interpolation(spark):
    target, probs, df = scored_frame(spark, grain=30)
    counts = ranking.score_counts(ranking.class_scores(df))
    points = ranking.roc_points(counts)
    curves = {k: roc_corners(target == k, probs[:, k]) for k in range(4)}
    found = points.orderBy("class_index", "seq").collect()
    for k, (fpr, tpr) in curves.items():
        own = [r for r in found if r.class_index == k]
        assert [r.fpr for r in own] == pytest.approx(list(fpr)) and [r.tpr for r in own] == pytest.approx(list(tpr))
    areas = {r.class_index: r.auc for r in ranking.curve_auc(points).collect()}
    for k in range(4):
        assert areas[k] == pytest.approx(rank_auc(target == k, probs[:, k]))

    grid = np.unique(np.concatenate([fpr for fpr, _ in curves.values()]))
    mean = sum(np.interp(grid, *curves[k]) for k in range(4)) / 4
    curve = ranking.macro_curve(points, 4).orderBy("fpr").collect()
    assert [r.fpr for r in curve] == pytest.approx(list(grid))
    assert [r.tpr for r in curve] == pytest.approx(list(mean))
    area = ranking.macro_curve_auc(ranking.macro_curve(points, 4)).first().auc
    assert area == pytest.approx(np.trapezoid(mean, grid))


def test_calibration_of_extreme_confidences(spark):
    rows = [(1, 1.0, True), (2, 0.0, False), (3, 0.4, True)]
    predicted = spark.createDataFrame(rows, "id int, confidence double, correct boolean")
    table = {r.bin: r for r in confusion.calibration_bins(predicted).collect()}
    assert len(table) == 15 and table[14]["count"] == 1 and table[0]["count"] == 1
    assert table[7].gap is None and table[14].upper == 1.0


def test_weight_search_prefers_macro_f1_then_loss_and_skips_the_endpoints(spark):
    first = spark.createDataFrame([(i, i % 2, [0.9, 0.1] if i % 2 == 0 else [0.45, 0.55]) for i in range(20)], "id bigint, target int, probs array<double>")
    second = spark.createDataFrame([(i, i % 2, [0.6, 0.4] if i % 2 == 0 else [0.1, 0.9]) for i in range(20)], "id bigint, target int, probs array<double>")
    table = {r.second_weight: r for r in scores.weight_search(first, second, 2).collect()}
    assert set(table) == {0.0, 0.25, 0.5, 0.75, 1.0} and not table[0.0].eligible and not table[1.0].eligible
    best = min((w for w in table if table[w].eligible), key=lambda w: (-table[w].validation_macro_f1, table[w].validation_loss))
    assert [w for w in table if table[w].chosen] == [best]
    voted = scores.chosen_vote(first, second, scores.weight_search(first, second, 2)).filter("id = 0").first().probs
    assert voted == pytest.approx([(1 - best) * 0.9 + best * 0.6, (1 - best) * 0.1 + best * 0.4])
    assert scores.soft_vote(first, second, 0.5).filter("id = 1").first().probs == pytest.approx([0.275, 0.725])


def test_condition_drop(spark):
    rows = [("clean", "m", 0, 0)] * 9 + [("clean", "m", 0, 1)] + [("dark", "m", 0, 0)] * 7 + [("dark", "m", 1, 0)] * 3
    sweep = confusion.condition_sweep(spark.createDataFrame(rows, "condition string, model string, true_index int, predicted_index int"), 2)
    assert {r.condition: r.accuracy_drop_pp for r in sweep.collect()} == {"clean": pytest.approx(0.0), "dark": pytest.approx(20.0)}


def test_centroid_scores_equal_a_direct_computation(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(60, 6))
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(values)]
    features = spark.createDataFrame(rows, "id bigint, target int, features array<double>").repartition(4)
    found = {r.id: r.probs for r in scores.centroid_scores(features, scores.centroids(features)).collect()}
    centres = np.array([values[k::3].mean(axis=0) for k in range(3)])
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    z = np.exp(10 * unit @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T)
    for i in range(60):
        assert found[i] == pytest.approx(list(z[i] / z[i].sum()))


@pytest.mark.parametrize("size", [3, 4, 100])
def test_blocks_of_labels_give_the_same_scores_and_predictions(spark, size):
    rng = np.random.default_rng(2)
    labels = [0, 1, 2, 5, 6, 17]  # whole blocks of three have no label
    rows = [(i, labels[i % 6] if i % 7 else 9, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 5)))]
    features = spark.createDataFrame(rows, "id bigint, target int, features array<double>")
    model = scores.centroids(features.filter("target <> 9"))
    dense = scores.centroid_scores(features, model)
    blocked = {r.id: r.probs for r in scores.centroid_scores(features, model, size=size).collect()}
    assert all(blocked[r.id] == pytest.approx(r.probs, abs=1e-12) for r in dense.collect())
    wanted = {r.id: r for r in scores.predictions(dense).collect()}
    for r in scores.centroid_predictions(features, model, size=size).collect():
        w = wanted[r.id]
        assert (r.true_index, r.predicted_index, r.correct) == (w.true_index, w.predicted_index, w.correct)
        assert (r.confidence, r.true_probability) == (pytest.approx(w.confidence), pytest.approx(w.true_probability))


def test_several_groups_of_rows_meet_the_blocks_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(scores, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(5)
    rows = [(i, i % 10, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(12_000, 64)))]
    features = spark.createDataFrame(rows, "id bigint, target int, features array<double>")
    model = scores.centroids(features)
    wanted = {r.id: r for r in scores.predictions(scores.centroid_scores(features, model)).collect()}
    found = scores.centroid_predictions(features, model, size=4).collect()
    assert sorted(r.id for r in found) == list(range(12_000))
    for r in found:
        w = wanted[r.id]
        assert (r.predicted_index, r.confidence) == (w.predicted_index, pytest.approx(w.confidence))


def test_fifty_thousand_labels(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50_000, 4))
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    model = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(unit)], "target int, centroid array<double>")
    asked = rng.integers(0, 50_000, 40)
    features = spark.createDataFrame([(i, int(k), [float(x) for x in centres[k] * 3]) for i, k in enumerate(asked)], "id bigint, target int, features array<double>")
    found = scores.centroid_predictions(features, model, sharpness=1e4).collect()
    assert len(found) == 40 and all(r.correct for r in found)
    z = np.exp(1e4 * (unit @ unit[asked].T - 1))
    assert all(r.confidence == pytest.approx(1 / z[:, r.id].sum(), rel=1e-6) for r in found)


def test_a_splitting_tree_draws_a_multinomial():
    weights, samples = np.array([5, 0, 3, 100, 7, 7, 0, 1]), 3000
    drawn = resampling.split_counts(np.full(samples, 123), weights, np.arange(samples), 3, 0, 1)
    share = weights / 123
    assert (drawn.sum(axis=1) == 123).all() and (drawn[:, weights == 0] == 0).all()
    assert np.abs(drawn.mean(axis=0) - weights).max() < 0.4
    covariance = np.cov(drawn.T)
    assert np.abs(covariance - 123 * (np.diag(share) - np.outer(share, share))).max() < 1.6


def test_draws_equal_the_distributions():
    at = (np.arange(20_000) + 0.5) / 20_000
    import math

    binomial = resampling.binomial_counts(40, 0.3, at)
    exact = [math.comb(40, k) * 0.3**k * 0.7 ** (40 - k) for k in range(41)]
    assert np.abs(np.bincount(binomial, minlength=41) / 20_000 - exact).max() < 1.1e-4
    poisson = resampling.poisson_counts(6.5, at)
    exact = [math.exp(-6.5) * 6.5**k / math.factorial(k) for k in range(40)]
    assert np.abs(np.bincount(poisson, minlength=40)[:40] / 20_000 - exact).max() < 1.1e-4
    assert resampling.binomial_counts(10**9, 0.5, np.array([0.5])).tolist() == [500_000_000]


def test_evaluate_builds_every_table(spark):
    _, _, df = scored_frame(spark)
    tables = evaluation.evaluate(df, 4, samples=20)
    assert tables.class_report.count() == 4 and tables.calibration.count() == 15
    row = tables.summary.first()
    assert 0 < row.accuracy < 1 and row.ece >= 0 and row.macro_auc is not None
    assert tables.intervals.first().samples == 20
    unknown = confusion.unknown_targets(
        spark.createDataFrame([("x", "a"), ("y", "zz")], "source_class string, target_class string"),
        spark.createDataFrame([(0, "a")], "class_index int, class_name string"),
    )
    assert [r.target_class for r in unknown.collect()] == ["zz"]


def test_centroids_stand_at_their_labels(spark):
    rows = [(0, 0, [1.0, 0.0, 0.0]), (1, 2, [0.0, 1.0, 0.0]), (2, 5, [0.0, 0.0, 1.0])]
    features = spark.createDataFrame(rows, "id bigint, target int, features array<double>")
    scored = scores.predictions(scores.centroid_scores(features, scores.centroids(features))).collect()
    assert all(r.predicted_index == r.true_index and r.correct for r in scored)
    assert all(len(r.probs) == 6 and r.probs[1] == r.probs[3] == r.probs[4] == 0.0 and sum(r.probs) == pytest.approx(1.0) for r in scored)
    unseen = features.filter("target <> 5")
    assert {r.true_index: r.correct for r in scores.predictions(scores.centroid_scores(features, scores.centroids(unseen))).collect()} == {0: True, 2: True, 5: False}


def test_a_mapping_to_an_unknown_class_fails(spark):
    from veriset.operators.checks import ContractError

    mapping = spark.createDataFrame([("x", "a"), ("y", "nowhere")], "source_class string, target_class string")
    classes = spark.createDataFrame([("a", 0)], "class_name string, class_index int")
    with pytest.raises(ContractError, match="mapped_classes_exist"):
        confusion.mapped_targets(spark.createDataFrame([("x",)], "source_class string"), mapping, classes)
