"""Background matching, audits, gates, and the join plans behind them."""

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators import enrich, linking
from riskgraph.session import new_scratch_path
from riskgraph.sources import stores
from riskgraph.sources.sample import SAMPLE_EDGE_FEATURES, SampleTables

FEATURES = ["feat#1", "feat#2"]


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "node_id long, component_id long")


def background(spark, rows):
    return spark.createDataFrame(rows, "clId long, `feat#1` double, `feat#2` double, other string")


def test_statistics_skip_null_and_uncovered_components_stay_null(spark, nodes):
    rows = [(1, 1.0, None, "x"), (2, 3.0, 5.0, "x"), (3, 7.0, 7.0, "x"), (9, 0.0, 0.0, "x")]
    matched = enrich.match_node_features(background(spark, rows), nodes, FEATURES)
    aggregates = enrich.aggregate_node_features(matched, FEATURES)
    store = spark.createDataFrame([(10,), (20,), (30,)], "component_id long")
    found = {r.component_id: r for r in enrich.attach_node_aggregates(store, aggregates).collect()}
    assert found[10].matched_node_count == 2
    assert (found[10].node_feat_01_mean, found[10].node_feat_01_sd) == (2.0, 1.0)
    assert (found[10].node_feat_02_min, found[10].node_feat_02_max) == (5.0, 5.0)
    assert found[30].matched_node_count is None and found[30].node_feat_01_mean is None
    filled = {r.component_id: r for r in enrich.attach_edge_aggregates(store, aggregates).collect()}
    assert filled[30].matched_node_count == 0 and filled[30].node_feat_01_mean == 0.0
    assert enrich.enrichment_coverage(
        enrich.attach_node_aggregates(store.withColumn("label", F.lit(1)), aggregates),
        "matched_node_count",
        "node_feat_01_mean",
    ).first() == (3, 3, 1, 1)


def test_large_key_set_is_shuffled_with_the_same_result(spark, nodes):
    rows = [(i % 6, float(i), 1.0, "x") for i in range(30)]
    df = background(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = enrich.match_node_features(df, nodes, FEATURES)
        large = enrich.match_node_features(df, nodes, FEATURES, broadcast_rows=2)
        assert "BroadcastHashJoin" in plan(small)
        assert "SortMergeJoin" in plan(large) and "SortMergeJoin" not in plan(small)
        assert sorted(small.collect()) == sorted(large.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("on", [("a",), ("a", "b", "c")])
def test_background_rows_without_a_key_fall_before_the_exchange(spark, on):
    """The key sketch keeps every row with a known key, and few of the others."""
    columns = [(F.col("id") * f).alias(c) for c, f in (("a", 1), ("b", 3), ("c", 5))]
    background = spark.range(200_000).select(*columns, F.rand(1).alias("x")).persist()
    keys = spark.range(0, 200_000, 40).select(*columns).select(*on)
    kept = enrich.with_known_keys(background, keys, on, keys.count())
    assert kept.columns == background.columns
    assert kept.join(keys, list(on)).count() == background.join(keys, list(on)).count() == 5000
    assert 5000 <= kept.count() < 5000 + 195_000 * 0.06
    assert enrich.with_known_keys(background, keys.limit(0), on, 0).count() == 0
    # The sketch has a bounded number of rows, and nothing but it is exchanged.
    assert enrich.key_sketch(keys, on, 64).count() == 64
    assert plan(kept).count("Exchange hashpartitioning(__place") == 1 and "SortMergeJoin" not in plan(kept)
    background.unpersist()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_background_scan_reads_only_key_and_features(spark, nodes):
    path = new_scratch_path(spark, "wide")
    background(spark, [(1, 1.0, 2.0, "x")]).write.parquet(path)
    matched = enrich.match_node_features(spark.read.parquet(path), nodes, ["feat#1"])
    assert "ReadSchema: struct<clId:bigint,feat#1:double>" in plan(matched)


def test_node_gate_fires_and_leaves_its_audit(spark, nodes):
    matched = enrich.match_node_features(
        background(spark, [(1, 1.0, 1.0, "x"), (1, 2.0, 2.0, "x")]), nodes, FEATURES
    )
    audit = enrich.node_match_audit(nodes, matched)
    row = audit.first()
    assert (row.labeled_node_rows, row.missing_labeled_nodes, row.duplicate_background_matches) == (4, 3, 1)
    path = new_scratch_path(spark, "audit")
    with pytest.raises(IntegrityError, match="missing_labeled_nodes"):
        stores.enforce(audit, enrich.NODE_GATE, path)
    assert spark.read.json(path).first().missing_labeled_nodes == 3


def test_edge_gate_passes_and_fires(spark):
    def audit_of(folder):
        t = SampleTables(spark, folder)
        keys = enrich.edge_source_component(t.clean_edges(), t.nodes())
        features = [f"feat#{i}" for i in range(1, SAMPLE_EDGE_FEATURES + 1)]
        matched = enrich.match_edge_features(t.background_edges(), keys, features)
        return enrich.edge_match_audit(keys, matched)

    with pytest.raises(IntegrityError, match="duplicate_labeled_edge_keys"):
        stores.enforce(audit_of("/root/testdata/sf0.001"), enrich.EDGE_GATE)
    stores.enforce(audit_of("/root/testdata/sf0.01"), enrich.EDGE_GATE)


def test_hot_endpoint_is_split_by_adaptive_execution(spark):
    """A node that sends a third of all edges: its join partition is split, no row is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    n = 300000
    edges = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("source_node_id"),
        (F.col("id") % 5000).alias("target_node_id"),
        F.col("id").alias("transaction_id"),
    )
    nodes = spark.range(5000).select(F.col("id").alias("node_id"), (F.col("id") % 10).alias("component_id"))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        mapped = enrich.edge_source_component(edges, nodes)
        mapped.write.format("noop").mode("overwrite").save()
        rows = mapped.collect()
        assert "skew=true" in plan(mapped)
        both = linking.edge_component_map(edges, nodes)
        assert both.count() == n
        # A node that receives two thirds: the job that writes the valid edges splits it.
        swapped = edges.select(
            F.col("target_node_id").alias("source_node_id"),
            F.when(F.col("transaction_id") % 3 > 0, 1).otherwise(F.col("source_node_id")).alias("target_node_id"),
            "transaction_id",
        )
        valid = linking.valid_edges(linking.edge_component_map(swapped, nodes))
        valid.write.format("noop").mode("overwrite").save()
        valid.collect()
        assert "skew=true" in plan(valid)
        assert linking.written_valid_edges(swapped, nodes).count() == valid.count()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(rows) == n and all(r.component_id is not None for r in rows)


def test_plain_rows_move_and_hot_components_are_combined_first(spark, tmp_path):
    rows = [(i % 5 if i < 50 else 9, float(i), None if i % 3 else 2.0 * i) for i in range(300)] + [(None, 1.0, 1.0)]
    spark.createDataFrame(rows, "component_id long, `feat#1` double, `feat#2` double").write.parquet(f"{tmp_path}/matched")
    matched = spark.read.parquet(f"{tmp_path}/matched")
    plain = enrich._aggregate(matched, FEATURES, "f", "n")
    mixed = enrich._aggregate(matched, FEATURES, "f", "n", hot_rows=100)
    assert {r.component_id: r.n for r in plain.collect()} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 9: 250}

    def rounded(df):
        return sorted(tuple(round(v, 9) for v in r) for r in df.collect())

    assert rounded(plain) == rounded(mixed)
    # The exchange lies below both halves of the aggregation, where a row has one number a feature.
    below = plan(plain).split("Exchange hashpartitioning")[-1]
    assert "HashAggregate" not in below and "HashAggregate" in plan(mixed).split("Exchange hashpartitioning")[-1]


def test_keys_of_the_sample_edges_cost_no_features(spark):
    t = SampleTables(spark, "/root/testdata/sf0.001")
    assert len(t.paired_items().columns) == 8
    assert len(t.background_edges().columns) == 3 + SAMPLE_EDGE_FEATURES
    assert "feat#" not in plan(t.raw_clean_edges()).split("Scan parquet")[1]
    assert t.background_edges().count() == 2 * t.raw_clean_edges().count()


def test_key_sketch_keeps_its_bits_a_key_at_tens_of_millions_of_keys():
    for n_keys in (1, 1000, 9_000_000, 16_000_000):
        assert enrich.sketch_rows(n_keys) * 64 >= n_keys * enrich.SKETCH_BITS
    # Four bits a key or more still drop nine in ten of the other rows.
    assert enrich.sketch_rows(54_000_000) * 64 >= 4 * 54_000_000
    assert enrich.sketch_rows(10**12) == enrich.SKETCH_ROWS
