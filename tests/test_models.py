"""Fits, calibration and validation runs on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from riskgraph.functions.labels import numeric_features
from riskgraph.operators import gates, metrics, models, splits
from riskgraph.plans import review as runs


@pytest.fixture(scope="module")
def store(spark):
    """Two informative features, one constant, one noise."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    label = (F.col("id") % 10 == 0).cast("int")
    return spark.range(600).select(
        F.col("id").alias("component_id"),
        label.alias("label"),
        (label * 2 + noise).alias("signal"),
        (noise - label * 0.3).alias("weaker"),
        F.lit(4.0).alias("constant"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("noise"),
    ).persist()


def test_scaling_uses_training_rows_and_keeps_constants_finite(store):
    names = numeric_features(store)
    train = store.filter("component_id < 300")
    moments = models.training_moments(train, names)
    assert moments.sd["constant"] == 1.0
    scaled = models.standardize_features(train, names, moments)
    row = scaled.agg(F.avg("signal").alias("m"), F.stddev_pop("signal").alias("s"), F.max("constant").alias("c")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1) and row.c == 0


def test_class_weights(store):
    rows = {r.label: r for r in models.balanced_class_weights(store).collect()}
    assert rows[1].class_weight == pytest.approx(600 / (2 * 60))
    assert rows[0].class_weight == pytest.approx(600 / (2 * 540))
    assert rows[0].positive_weight == pytest.approx(9.0)


def test_logistic_fit_is_the_penalised_optimum(store):
    """The gradient of the weighted loss plus half the squared norm is zero."""
    fitted = models.fit_logistic(store, ["noise", "weaker"])
    scored = {r.component_id: r.risk_score for r in fitted.score(store).collect()}
    coefficients = dict(zip(fitted.features, fitted.model.coefficients.toArray()))
    weight = {1: 600 / 120, 0: 600 / 1080}
    rows = store.collect()
    for name in fitted.features:
        gradient = coefficients[name] + sum(
            weight[r.label]
            * (scored[r.component_id] - r.label)
            * (r[name] - fitted.moments.mean[name])
            / fitted.moments.sd[name]
            for r in rows
        )
        assert abs(gradient) < 0.05 * len(rows) / 100
    intercept = sum(weight[r.label] * (scored[r.component_id] - r.label) for r in rows)
    assert abs(intercept) < 0.5


def test_baselines_score_test_rows_and_find_the_signal(store):
    train, test = models.train_test(store)
    fitted = models.fit_baselines(train, trees=20)
    scored = models.score_cases(fitted, test).persist()
    assert scored.count() == 2 * test.count() == 240
    assert scored.filter("risk_score NOT BETWEEN 0 AND 1").count() == 0
    quality = {r.model: r for r in metrics.global_metrics(scored).collect()}
    assert quality["random_forest"].average_precision > 0.9
    importance = models.feature_importance(*fitted, store).collect()
    assert importance[0].feature == "signal"
    assert sum(r.random_forest_importance for r in importance) == pytest.approx(1.0)


def test_forest_is_repeatable(store):
    first = models.fit_random_forest(store, trees=5).score(store).collect()
    again = models.fit_random_forest(store.repartition(5), trees=5).score(store).collect()
    assert sorted(first) == sorted(again)


def test_forest_in_parts_is_repeatable_and_keeps_repeated_rows(store):
    """Two trees a part: six trees in three parts, none held as one model; a row that comes twice is scored twice."""
    forest = models.fit_random_forest(store, trees=6, part_rows=1200)
    assert forest.model is None and [n for _, n in forest.parts] == [2, 2, 2]
    assert sum(forest.importances) == pytest.approx(1.0)
    assert forest.features[forest.importances.index(max(forest.importances))] == "signal"
    once = forest.score(store).collect()
    again = models.fit_random_forest(store.repartition(5), trees=6, part_rows=1200).score(store).collect()
    assert sorted(once) == sorted(again) and len(once) == 600
    assert sorted(forest.score(store.union(store)).collect()) == sorted(once + once)
    assert {r.label: r.risk_score > 0.5 for r in once} == {0: False, 1: True}


def test_null_features_are_refused(store):
    broken = store.withColumn("noise", F.when(F.col("component_id") > 3, F.col("noise")))
    with pytest.raises(Exception, match="null"):
        models.fit_random_forest(broken, ["noise"], trees=2)


def test_calibration_keeps_or_flattens_the_ranking(store):
    scores = models.calibration_scores(store, trees=20).persist()
    by_method = {r.method: r["count"] for r in scores.groupBy("method").count().collect()}
    assert by_method == {"raw_random_forest": 120, "sigmoid": 120, "isotonic": 120}
    wide = scores.groupBy("component_id").pivot("method").agg(F.first("risk_score")).collect()
    wide.sort(key=lambda r: r.raw_random_forest)
    sigmoid, isotonic = [r.sigmoid for r in wide], [r.isotonic for r in wide]
    assert sigmoid == sorted(sigmoid) and isotonic == sorted(isotonic)


def test_repeated_splits_and_shuffled_labels(store):
    scored = models.repeated_splits(store, seeds=(11, 23), trees=10)
    quality = metrics.ranking_and_brier(scored, ("seed", "model")).collect()
    assert len(quality) == 4 and all(0 <= r.brier_score <= 1 for r in quality)
    blind = {r.model: r for r in models.permutation_sanity(store, trees=10).collect()}
    assert blind["random_forest"].roc_auc < 0.9


def gate_inputs(spark, ap=0.6, std=0.01, shuffled=0.03, names=""):
    summary = spark.createDataFrame(
        [("random_forest", ap, std, ap - std, 0.9)],
        "model string, average_precision_mean double, average_precision_std double, "
        "average_precision_min double, roc_auc_mean double",
    )
    budgets = spark.createDataFrame(
        [("random_forest", 0.005, 0.9, 40.0, 100.0)],
        "model string, review_fraction double, precision_at_budget_mean double, "
        "lift_at_budget_mean double, suspicious_captured_mean double",
    )
    permutation = spark.createDataFrame(
        [("random_forest", shuffled, 0.51, 0.02)],
        "model string, average_precision double, roc_auc double, base_rate double",
    )
    audit = spark.createDataFrame(
        [(0, 0, names)],
        "duplicate_component_ids long, nonfinite_feature_values long, potential_target_name_columns string",
    )
    return summary, budgets, permutation, audit


def test_validation_gate_fires_on_each_check(spark):
    assert gates.validation_gate(*gate_inputs(spark)).first().status == "hard_checks_pass"
    for change, flag in (
        ({"std": 0.2}, "repeated_split_stability_pass"),
        ({"ap": 0.1}, "repeated_split_stability_pass"),
        ({"ap": 0.0, "std": 0.0}, "repeated_split_stability_pass"),
        ({"shuffled": 0.5}, "permutation_sanity_pass"),
        ({"names": "is_licit"}, "schema_leakage_audit_pass"),
    ):
        row = gates.validation_gate(*gate_inputs(spark, **change)).first()
        assert row.status == "review_required" and row[flag] is False


def test_dominance(spark):
    one = spark.createDataFrame([("b", 0.5), ("a", 0.5)], "feature string, random_forest_importance double")
    row = gates.dominance_review(one).first()
    assert (row.top_feature, row.manual_review_recommended) == ("a", True)
    flat = spark.createDataFrame(
        [(f"f{i:02d}", 1 / 20) for i in range(20)], "feature string, random_forest_importance double"
    )
    row = gates.dominance_review(flat).first()
    assert row.top_10_cumulative_importance == pytest.approx(0.5) and not row.manual_review_recommended


def test_class_separation_with_a_constant(store):
    rows = {r.feature: r for r in gates.class_separation(store).collect()}
    assert rows["constant"].standardized_mean_difference == 0.0
    assert rows["signal"].standardized_mean_difference > 1
    values = [r.abs_standardized_mean_difference for r in gates.class_separation(store).collect()]
    assert values == sorted(values, reverse=True)


def test_canonical_run(spark):
    """Five positive diamonds with tails and fifteen single-edge negatives."""
    labels_, nodes, edges = [], [], []
    for c in range(20):
        name, positive = f"C{c:02d}", c < 5
        labels_.append((name, int(positive)))
        size = 5 if positive else 2
        nodes += [(name, f"{name}_{i}") for i in range(size)]
        shape = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)] if positive else [(0, 1)]
        edges += [(name, f"{name}_{a}", f"{name}_{b}") for a, b in shape]
    run = runs.canonical_review(
        spark.createDataFrame(labels_, "component_id string, label int"),
        spark.createDataFrame(nodes, "component_id string, node_id string"),
        spark.createDataFrame(edges, "component_id string, source string, target string"),
        trees=10,
    )
    assert run.queue.count() == math.ceil(20 * 0.35)
    assert {r.model: r.average_precision for r in run.metrics.collect()}[run.model] == 1.0
    assert {r.review_fraction for r in run.budgets.collect()} == {0.25, 0.5, 1.0}
    assert run.queue.filter("rank = 1").first().component_id in {f"C{c:02d}" for c in range(5)}


def test_fit_rows_are_bounded_and_repeatable(store):
    assert models.bounded_rows(store).count() == 600
    some = models.bounded_rows(store, 200)
    assert 140 < some.count() < 260
    assert some.exceptAll(models.bounded_rows(store, 200)).count() == 0


def test_forest_tasks_hang_on_rows_alone(store):
    assert models._training_rows(store, 600).rdd.getNumPartitions() == models.LEAST_TASKS
    assert models._training_rows(store, 250_000).rdd.getNumPartitions() == models.LEAST_TASKS + 2
