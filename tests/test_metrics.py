"""Ranking and calibration metrics against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions.bins import bin_edges
from riskgraph.operators import metrics, ranking

SCHEMA = "component_id long, risk_score double, label int, model string"


def brute(rows):
    """Average precision over distinct thresholds, pairwise ROC AUC, base rate."""
    positives = sum(y for _, s, y, _ in rows)
    negatives = len(rows) - positives
    ap, before = 0.0, 0.0
    for cut in sorted({s for _, s, _, _ in rows}, reverse=True):
        taken = [y for _, s, y, _ in rows if s >= cut]
        recall = sum(taken) / positives if positives else 0.0
        ap += (recall - before) * sum(taken) / len(taken)
        before = recall
    won = sum(
        (a > b) + 0.5 * (a == b)
        for _, a, y, _ in rows if y
        for _, b, z, _ in rows if not z
    )
    auc = won / (positives * negatives) if positives and negatives else None
    return ap, auc, positives / len(rows)


def cases():
    rng = random.Random(11)
    sets = {
        "tied": [(i, 0.5, i % 2, "tied") for i in range(20)],
        "single": [(1, 0.3, 1, "single")],
        "no_positive": [(i, rng.random(), 0, "no_positive") for i in range(10)],
        "all_positive": [(i, rng.random(), 1, "all_positive") for i in range(10)],
        "many_ties": [(i, rng.randint(0, 9) / 9, int(rng.random() < 0.2), "many_ties") for i in range(200)],
        "distinct": [(i, rng.random(), int(rng.random() < 0.1), "distinct") for i in range(150)],
        "edges": [(i, e, i % 2, "edges") for i, e in enumerate(bin_edges() + [0.3, 0.1])],
    }
    return sets


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([r for rows in cases().values() for r in rows], SCHEMA)


def test_global_metrics(scored):
    found = {r.model: r for r in metrics.global_metrics(scored).collect()}
    for name, rows in cases().items():
        ap, auc, base = brute(rows)
        assert found[name].average_precision == pytest.approx(ap), name
        assert found[name].roc_auc == (None if auc is None else pytest.approx(auc)), name
        assert found[name].base_rate == pytest.approx(base), name


def test_roc_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = cases()["many_ties"]
    df = spark.createDataFrame(rows, SCHEMA)
    ours = metrics.roc_auc(df).first().roc_auc
    theirs = BinaryClassificationEvaluator(
        rawPredictionCol="risk_score", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(df)
    assert ours == pytest.approx(theirs)


def test_budgets(scored):
    found = {(r.model, r.review_fraction): r for r in metrics.review_budget_metrics(scored).collect()}
    for name, rows in cases().items():
        ranked = [y for _, _, y, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
        for f in metrics.BUDGETS:
            k = max(1, min(len(ranked), math.ceil(len(ranked) * f)))
            row, captured, positives = found[(name, f)], sum(ranked[:k]), sum(ranked)
            assert (row.reviews, row.suspicious_captured) == (k, captured)
            assert row.precision_at_budget == pytest.approx(captured / k)
            assert row.recall_at_budget == pytest.approx(captured / positives if positives else 0)
            base = positives / len(ranked)
            assert row.lift_at_budget == pytest.approx(captured / k / base if base else 0)


def test_perfect_ranking_and_empty_input(spark):
    rows = [(i, 1.0 - i / 10, int(i < 2), "m") for i in range(6)]
    row = metrics.review_budget_metrics(spark.createDataFrame(rows, SCHEMA), [1 / 3]).first()
    assert (row.precision_at_budget, row.recall_at_budget, row.lift_at_budget) == (1.0, 1.0, 3.0)
    with pytest.raises(IntegrityError):
        metrics.review_budget_metrics(spark.createDataFrame([], SCHEMA))


def test_calibration(scored):
    table = {}
    for r in metrics.calibration_bins(scored).collect():
        table.setdefault(r.model, {})[r.bin_id] = r
    ece = {r.model: r.ece for r in metrics.expected_calibration_error(scored).collect()}
    combined = {r.model: r for r in metrics.calibration_method_metrics(scored, "model").collect()}
    edges = bin_edges()
    for name, rows in cases().items():
        gaps = 0.0
        assert sorted(table[name]) == list(range(10))
        for b in range(10):
            inside = [
                (s, y) for _, s, y, _ in rows
                if (edges[b] < s or (b == 0 and s == 0.0)) and s <= edges[b + 1]
            ]
            row = table[name][b]
            assert (row.cases, row.lower, row.upper) == (len(inside), edges[b], edges[b + 1])
            if inside:
                gap = abs(sum(y for _, y in inside) - sum(s for s, _ in inside)) / len(inside)
                assert row.absolute_gap == pytest.approx(gap)
                gaps += gap * len(inside)
            else:
                assert row.observed_rate is None and row.mean_score is None
        brier = sum((s - y) ** 2 for _, s, y, _ in rows) / len(rows)
        clip = [min(max(s, 1e-12), 1 - 1e-12) for _, s, _, _ in rows]
        loss = -sum(math.log(p) if y else math.log(1 - p) for p, (_, _, y, _) in zip(clip, rows)) / len(rows)
        assert ece[name] == pytest.approx(gaps / len(rows))
        assert combined[name].ece == pytest.approx(gaps / len(rows))
        assert combined[name].brier_score == pytest.approx(brier)
        assert combined[name].log_loss == pytest.approx(loss)


def test_scores_outside_every_bin_leave_no_error(spark):
    df = spark.createDataFrame([(1, 1.5, 1, "m")], SCHEMA)
    assert metrics.expected_calibration_error(df).first().ece is None


def test_model_choice(spark, scored):
    quality = spark.createDataFrame(
        [("tied", 0.2), ("distinct", 0.7)], "model string, average_precision double"
    )
    assert ranking.select_model(scored, metrics=quality) == "distinct"
    assert ranking.select_model(scored, "tied", quality) == "tied"
    assert ranking.select_model(scored.filter("model = 'tied'")) == "tied"
    with pytest.raises(IntegrityError):
        ranking.select_model(scored)
    with pytest.raises(IntegrityError):
        ranking.select_model(scored, "unknown")


def test_repeat_summary_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "model string, v double")
    row = metrics.repeat_summary(df, ["v"]).first()
    assert (row.v_mean, row.v_std, row.v_min, row.v_max) == (2.0, pytest.approx(math.sqrt(2)), 1.0, 3.0)


def test_queue_is_ranked_with_ties_by_id(spark):
    rows = [(i, (i % 4) / 4, 0, "m") for i in range(1000)]
    queue = ranking.review_queue(spark.createDataFrame(rows, SCHEMA), "m").orderBy("rank").collect()
    assert [r["rank"] for r in queue] == list(range(1, 1001))
    assert [(r.risk_score, r.component_id) for r in queue] == sorted(
        ((s, i) for i, s, _, _ in rows), key=lambda t: (-t[0], t[1])
    )
    assert queue[4].priority_band == "tier_1_top_0_5pct" and queue[5].priority_band == "tier_2_top_1pct"
    assert queue[0].reason_1 == "model-ranked component in tier 1 top 0 5pct"
