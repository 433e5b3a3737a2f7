"""Split sizes, repeatability, and exact label permutation."""

import math

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import splits


@pytest.fixture(scope="module")
def store(spark):
    return spark.range(1003).select(
        F.col("id").alias("component_id"), (F.col("id") % 37 == 0).cast("int").alias("label")
    )


def counts(df):
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    return row.n, row.p


@pytest.mark.parametrize("fraction", [0.2, 0.35, 0.5])
def test_sizes_are_exact_and_stratified(store, fraction):
    split = splits.stratified_split(store, fraction)
    n, p = counts(split.filter("is_test"))
    positives = counts(store)[1]
    assert n == math.ceil(1003 * fraction)
    assert abs(p - positives * n / 1003) < 1
    assert split.count() == 1003


def test_same_rows_for_any_partitioning_and_other_rows_for_another_seed(store):
    def test_ids(df, seed):
        return {r.component_id for r in splits.stratified_split(df, seed=seed).filter("is_test").collect()}

    assert test_ids(store, 42) == test_ids(store.repartition(7), 42)
    assert test_ids(store, 42) != test_ids(store, 43)


def test_three_parts_are_disjoint_and_complete(store):
    parts = splits.three_way_split(store)
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes["test"] == 201 and sizes["calibration"] == math.ceil(802 * 0.25)
    assert sum(sizes.values()) == 1003
    assert parts.select("component_id").distinct().count() == 1003
    held = splits.stratified_split(store).filter("is_test").select("component_id")
    assert parts.filter("part = 'test'").join(held, "component_id").count() == 201


def test_audit_counts_every_seed(store):
    audit = splits.split_audit(splits.repeated_parts(store, [11, 23])).collect()
    assert len(audit) == 4 and sum(r.components for r in audit) == 2006


def test_shuffled_labels_are_a_permutation(store):
    shuffled = splits.shuffle_labels(store)
    assert counts(shuffled) == counts(store)
    moved = shuffled.join(store.withColumnRenamed("label", "old"), "component_id")
    agreeing = moved.filter("label = 1 AND old = 1").count()
    assert agreeing < counts(store)[1] / 2
