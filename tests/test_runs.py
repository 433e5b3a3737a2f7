"""Resumable stages, validation, calibration and comparison runs, and forests in shards."""

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators import models
from riskgraph.plans import shards, validation
from riskgraph.plans.stages import Stages

TREES = 5


@pytest.fixture(scope="module")
def store(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    label = (F.col("id") % 10 == 0).cast("int")
    return spark.range(500).select(
        F.col("id").alias("component_id"), label.alias("label"),
        (label * 2 + noise).alias("signal"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("noise"),
    ).persist()


class Killed(Exception):
    pass


def test_stages_are_built_once_and_half_written_ones_again(spark, tmp_path):
    folder = str(tmp_path / "run")
    first = Stages(spark, folder, {"a": 1})
    assert first.table("one", lambda: spark.range(3)).count() == 3
    assert Stages(spark, folder, {"a": 1}).table("one", lambda: 1 / 0).count() == 3
    (tmp_path / "run" / "one" / "_SUCCESS").unlink()
    again = Stages(spark, folder, {"a": 1})
    assert again.table("one", lambda: spark.range(4)).count() == 4
    assert [tuple(r) for r in again.manifest().orderBy("place").collect()] == [(0, "settings", False), (1, "one", True)]
    with pytest.raises(IntegrityError, match="settings"):
        Stages(spark, folder, {"a": 2})


def test_a_killed_validation_goes_on_with_the_third_seed(store, tmp_path):
    fitted = []

    def fit(train, features, seed):
        if len(fitted) == 2 and seed == 42:
            raise Killed
        fitted.append(seed)
        return models.fit_baselines(train, features, seed, TREES)

    folder, seeds = str(tmp_path / "run"), (11, 23, 42, 71, 101)
    with pytest.raises(Killed):
        validation.validation_run(store, folder, seeds, trees=TREES, fit=fit)
    assert fitted == [11, 23]
    fitted.append("again")
    run = validation.validation_run(store, folder, seeds, trees=TREES, fit=fit)
    # Three seeds, the shuffled labels, and the split that importance comes from.
    assert fitted[3:] == [42, 71, 101, 42, 42]
    assert run.quality.count() == 10 and run.budgets.count() == 50
    assert {r.feature for r in run.importance.collect()} == {"signal", "noise"}
    assert run.gate.first().schema_leakage_audit_pass and run.summary.count() == 2
    assert run.reliability.count() == 20 and run.dominance.first().top_feature == "signal"
    built = {r.stage: r.built_now for r in run.manifest.collect()}
    assert not built["scores-11"] and built["scores-42"]


@pytest.mark.parametrize("broken", ["repeated", "nan", "label"])
def test_gates_come_before_any_fit(store, tmp_path, broken):
    dirty = {
        "repeated": lambda: store.union(store.limit(1)),
        "nan": lambda: store.withColumn("noise", F.when(F.col("component_id") == 3, float("nan")).otherwise(F.col("noise"))),
        "label": lambda: store.withColumn("label", F.when(F.col("component_id") == 3, 2).otherwise(F.col("label"))),
    }[broken]()
    with pytest.raises(IntegrityError):
        validation.validation_run(dirty, str(tmp_path / broken), trees=TREES, fit=lambda *_: pytest.fail("fitted"))


def test_calibration_run(store, tmp_path):
    run = validation.calibration_run(store, str(tmp_path / "run"), trees=TREES)
    assert {r.method for r in run.metrics.collect()} == {"raw_random_forest", "sigmoid", "isotonic"}
    assert run.bins.count() == 30 and run.budgets.count() == 15
    best = run.best.first()
    assert best.best_brier_score <= best.raw_brier_score
    assert sum(r.components for r in run.parts.collect()) == 500


def comparison_inputs(spark, store, n_graph=500):
    nodes = spark.range(n_graph * 2).select(F.col("id").alias("node_id"), (F.col("id") % n_graph).alias("component_id"), (F.col("id") % 7).cast("double").alias("x"))
    edges = spark.range(n_graph).select(F.col("id").alias("source_node_id"), (F.col("id") + n_graph).alias("target_node_id"), F.col("id").alias("component_id"))
    return {"nodes": nodes, "edges": edges, "components": store.select("component_id", "label").filter(F.col("component_id") < n_graph)}


def test_comparison_run(spark, store, tmp_path):
    graph = comparison_inputs(spark, store)
    run = validation.comparison_run(graph, store, ["x"], str(tmp_path / "run"), layers=1, trees=TREES)
    row = run.comparison.first()
    assert (row.first_model, row.second_model) == ("neighbor_aggregation", "random_forest")
    assert row.first_base_rate == row.second_base_rate and run.budgets.count() == 10


def test_comparison_needs_the_same_universe(spark, store, tmp_path):
    graph = comparison_inputs(spark, store, 480)
    with pytest.raises(IntegrityError, match="only_right"):
        validation.comparison_run(graph, store, ["x"], str(tmp_path / "run"), layers=1, trees=TREES)


def test_forest_in_shards_uses_every_row_once(store, tmp_path):
    train, test = models.train_test(store)
    n = 3
    ids = [{r.component_id for r in shards.shard_rows(train, i, n).collect()} for i in range(n)]
    assert sum(map(len, ids)) == len(set().union(*ids)) == train.count()
    size = -(-train.count() // n)
    out = shards.sharded_forest_scores(train, test, str(tmp_path / "run"), trees=TREES, shard_size=size)
    assert out.count() == test.count()
    parts = [models.fit_random_forest(shards.shard_rows(train, i, n), ["signal", "noise"], 42 + i, TREES).score(test) for i in range(n)]
    mean = {}
    for part in parts:
        for r in part.collect():
            mean[r.component_id] = mean.get(r.component_id, 0) + r.risk_score / n
    assert {r.component_id: r.risk_score for r in out.collect()} == pytest.approx(mean)
    one = shards.sharded_forest_scores(train, test, str(tmp_path / "one"), trees=TREES)
    assert one.count() == test.count()
