"""Percentiles, z-scores and case evidence against plain Python."""

import statistics

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators import evidence, profile, tables

SCHEMA = "component_id long, label int, a double, b double, c double"
ROWS = [
    (1, 0, 1.0, 5.0, 7.0), (2, 1, 2.0, 5.0, float("nan")), (3, 0, 2.0, 5.0, None),
    (4, 0, 3.0, 5.0, 1.0), (5, 1, 3.0, 5.0, 1.0), (6, 0, 3.0, 5.0, 9.0),
]
WEIGHTS = {"a": 0.5, "c": 0.3, "b": 0.2}


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def queue(spark):
    return spark.createDataFrame([(1, 4, 0.9), (2, 1, 0.8), (3, 2, 0.1)], "rank long, component_id long, risk_score double")


def test_percentile_is_the_average_rank(store):
    found = {(r.feature, r.component_id): r.percentile for r in evidence.average_rank_percentile(store, ["a", "b", "c"]).collect()}
    assert [found[("a", i)] for i in range(1, 7)] == pytest.approx([1 / 6, 2.5 / 6, 2.5 / 6, 5 / 6, 5 / 6, 5 / 6])
    assert [found[("b", i)] for i in range(1, 7)] == pytest.approx([3.5 / 6] * 6)
    assert found[("c", 2)] is None and found[("c", 3)] is None
    assert [found[("c", i)] for i in (1, 4, 5, 6)] == pytest.approx([0.75, 0.375, 0.375, 1.0])


def test_zscores_are_zero_for_constant_missing_or_infinite(spark, store):
    found = {(r.feature, r.component_id): r.zscore for r in evidence.feature_zscores(store, ["a", "b", "c"]).collect()}
    a = [r[2] for r in ROWS]
    for i, value in enumerate(a, 1):
        assert found[("a", i)] == pytest.approx((value - statistics.fmean(a)) / statistics.pstdev(a))
        assert found[("b", i)] == 0.0
    assert found[("c", 2)] == 0.0 and found[("c", 3)] == 0.0
    odd = spark.createDataFrame([(1, 0, float("inf"), 0.0, 0.0), (2, 0, 1.0, 0.0, 0.0)], SCHEMA)
    assert {r.zscore for r in evidence.feature_zscores(odd, ["a"]).collect()} == {0.0}


def test_top_evidence_long_and_wide(spark, store, queue):
    cases = evidence.require_evidence(evidence.case_evidence_topk(queue, store, WEIGHTS, 2)).persist()
    long = {(r.component_id, r.evidence_rank): r for r in evidence.evidence_long(cases).collect()}
    assert len(long) == 6
    z = {(r.feature, r.component_id): r.zscore for r in evidence.feature_zscores(store, list(WEIGHTS)).collect()}
    for component in (4, 1, 2):
        ordered = sorted(WEIGHTS, key=lambda f: (-WEIGHTS[f] * abs(z[(f, component)]), -WEIGHTS[f], f))
        assert [long[(component, k)].feature for k in (1, 2)] == ordered[:2]
    wide = evidence.evidence_wide(cases, 4)
    row = wide.filter("component_id = 4").first()
    assert row.evidence_1.startswith("c: value=1; ") or row.evidence_1.startswith("a: value=3; ")
    assert row.evidence_3 == "" and row.evidence_4 == ""
    assert wide.filter("component_id = 2").first().evidence_1.startswith("a: value=2; ")


def test_unmatched_queue_row_and_duplicate_store_are_refused(spark, store, queue):
    lost = queue.unionByName(spark.createDataFrame([(4, 99, 0.0)], queue.schema))
    with pytest.raises(IntegrityError):
        evidence.require_evidence(evidence.case_evidence_topk(lost, store, WEIGHTS))
    with pytest.raises(IntegrityError):
        evidence.case_evidence_topk(queue, store.union(store), WEIGHTS)


def test_candidates_skip_null_importance_and_absent_features(spark, store):
    table = spark.createDataFrame(
        [("a", 0.1), ("b", None), (None, 0.9), ("zzz", 0.8), ("c", 0.3)],
        "feature string, random_forest_importance double",
    )
    assert evidence.candidate_features(table, store, 3) == {"c": 0.3, "a": 0.1}
    with pytest.raises(IntegrityError):
        evidence.candidate_features(table.filter("feature = 'zzz'"), store)


def test_nonfinite_cells_and_audit(store):
    assert profile.nonfinite_count(store, ["a", "b", "c"]).first().nonfinite_values == 2
    leaky = store.withColumn("licit_share", F.lit(1.0))
    row = profile.leakage_audit(leaky.union(leaky)).first()
    assert (row.rows, row.positive_rows, row.negative_rows, row.feature_count) == (12, 4, 8, 4)
    assert (row.duplicate_component_ids, row.nonfinite_feature_values) == (6, 4)
    assert row.potential_target_name_columns == "licit_share"


def test_store_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, None)], "component_id long, label int")
    checks = {r.check: r.n for r in profile.store_qa(df).collect()}
    assert checks == {
        "row_count": 3, "missing_component_id": 1, "duplicate_component_ids": 1,
        "label_1": 1, "label_0": 1, "label_null": 1,
    }


def test_legacy_bands_and_empty_tiers(spark):
    old = spark.createDataFrame([("high",), ("high",), ("standard",)], "risk_band string")
    assert [(r.priority_tier, r.cases) for r in tables.band_counts(old).orderBy("tier_order").collect()] == [
        ("Critical", 0), ("High", 2), ("Elevated", 0), ("Standard", 1)
    ]
    new = spark.createDataFrame([("tier_5_top_10pct",)], "priority_band string")
    assert [r.cases for r in tables.band_counts(new).orderBy("tier_order").collect()] == [0, 0, 0, 0, 1, 0]


def test_pivot_orders_columns_by_mean_score(spark):
    rows = [(1, 10, "a", 1.0, 0.5), (1, 10, "b", -2.0, 0.9), (2, 20, "b", 3.0, 0.9), (3, 30, "a", 9.0, 9.0)]
    long = spark.createDataFrame(
        rows, "rank long, component_id long, feature string, zscore double, evidence_score double"
    )
    df = tables.case_feature_pivot(long, 2)
    assert df.columns == ["rank", "component_id", "b", "a"]
    assert df.collect() == [(1, 10, -2.0, 1.0), (2, 20, 3.0, None)]


def test_a_case_without_evidence_keeps_a_row(spark):
    item = "feature string, value double, percentile double, zscore double, importance double, evidence_score double"
    cases = spark.createDataFrame(
        [(1, None), (2, [("f", 1.0, 0.5, 0.1, 0.2, 0.3)])],
        "component_id long, evidence array<struct<" + ", ".join(x.strip().replace(" ", ":") for x in item.split(",")) + ">>",
    )
    rows = {(r.component_id, r.evidence_rank, r.feature) for r in evidence.evidence_long(cases).collect()}
    assert rows == {(1, None, None), (2, 1, "f")}
