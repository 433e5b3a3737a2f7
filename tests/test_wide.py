"""Statistics over very many columns, with NULLs, NaN and empty tables."""

import statistics
import time

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import evidence, gates, profile, wide

ROWS = [(1, 0, 1.0, None), (2, 1, 4.0, float("nan")), (3, 1, None, 2.0), (4, None, 7.0, float("inf"))]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "component_id long, label int, `a b` double, c double")


def test_moments_skip_nulls_and_nan(small):
    found = {r.feature: r for r in wide.moments(small, ["a b", "c"]).collect()}
    assert found["a b"].mean == 4.0 and found["a b"].n == 3
    assert found["a b"].sd == pytest.approx(statistics.pstdev([1.0, 4.0, 7.0]))
    assert found["c"].n == 2 and found["c"].mean == float("inf")


def test_counts(small):
    assert {r.feature: r.nulls for r in profile.null_counts(small).collect()} == {"a b": 1, "c": 1}
    assert profile.nonfinite_count(small, ["a b", "c"]).first().nonfinite_values == 4
    covered = [tuple(r) for r in profile.column_coverage(small, ["c", "a b"]).orderBy("ordinal").collect()]
    assert covered == [(1, "c", 3), (2, "a b", 3)]


def test_empty_tables_keep_a_row_per_feature(small):
    none = small.limit(0)
    assert {tuple(r) for r in profile.null_counts(none).collect()} == {("a b", 0), ("c", 0)}
    assert {r.feature: r.abs_standardized_mean_difference for r in gates.class_separation(none).collect()} == {"a b": 0.0, "c": 0.0}
    assert profile.nonfinite_count(none, ["c"]).first().nonfinite_values == 0
    assert evidence.feature_zscores(none, ["c"]).collect() == []


def test_573_columns_in_one_scan(spark):
    names = [f"f{i}" for i in range(573)]
    store = spark.range(5000).select(
        F.col("id").alias("component_id"), (F.col("id") % 2).cast("int").alias("label"),
        *[(F.col("id") % 2 * i + F.col("id") % 7).cast("double").alias(n) for i, n in enumerate(names)],
    ).persist()
    store.count()
    start = time.time()
    apart = {r.feature: r for r in gates.class_separation(store, names).collect()}
    assert len(apart) == 573 and time.time() - start < 30
    for i in (0, 5, 572):
        values = [(k % 2, k % 2 * i + k % 7) for k in range(5000)]
        mean = [statistics.fmean(v for y, v in values if y == c) for c in (0, 1)]
        want = (mean[1] - mean[0]) / statistics.pstdev(v for _, v in values)
        assert apart[f"f{i}"].standardized_mean_difference == pytest.approx(want)
    plan = gates.class_separation(store, names)._jdf.queryExecution().toString()
    assert plan.count("stddev_pop") < 10
    store.unpersist()
