"""Directed neighbour means, hops, pooling and the compact graph."""

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators import neighbors
from riskgraph.sources import stores


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(1, 1, 10.0), (2, 1, 20.0), (3, 1, 40.0), (4, 2, 5.0)], "node_id long, component_id long, x double"
    )
    # Two parallel edges 1->3 and one 2->3: the mean of node 3 is (10 + 10 + 20) / 3.
    edges = spark.createDataFrame([(1, 3), (1, 3), (2, 3)], "source_node_id long, target_node_id long")
    components = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None)], "component_id long, label int")
    return {"nodes": nodes, "edges": edges, "components": components}


def by_node(df, name):
    return {r.node_id: r[name] for r in df.collect()}


def test_forward_and_reverse_means(graph):
    forward = by_node(neighbors.neighbor_mean(graph["nodes"], graph["edges"], ["x"]), "in_x")
    assert forward == {1: 0.0, 2: 0.0, 3: pytest.approx(40 / 3), 4: 0.0}
    backward = by_node(neighbors.neighbor_mean(graph["nodes"], graph["edges"], ["x"], True, "out_"), "out_x")
    assert backward == {1: 40.0, 2: 40.0, 3: 0.0, 4: 0.0}


def test_hops_keep_own_forward_and_reverse_channels(graph):
    hops = neighbors.khop_dual_channel(graph["nodes"], graph["edges"], ["x"], 2)
    assert len(hops.columns) == 2 + 9
    found = by_node(hops, "in2_out1_x")
    assert found[3] == pytest.approx(40.0) and found[1] == 0.0
    with pytest.raises(ValueError):
        neighbors.khop_dual_channel(graph["nodes"], graph["edges"], ["x"], 0)


def test_pooling_and_components_without_nodes(graph):
    pooled = {r.component_id: r for r in neighbors.graph_mean_max_pool(graph["nodes"], ["x"]).collect()}
    assert (pooled[1].mean_x, pooled[1].max_x) == (pytest.approx(70 / 3), 40.0)
    rows = {r.component_id: r for r in neighbors.graph_component_features(graph, ["x"], 1).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[3].mean_x == 0.0


def test_dataset_profile_and_gate(spark):
    components = spark.createDataFrame([(1, 1), (2, None)], "component_id long, label int")
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node_id long, component_id long")
    edges = spark.createDataFrame(
        [(1, 2, 7), (1, 3, 8), (1, 9, 9)], "source_node_id long, target_node_id long, transaction_id long"
    )
    background = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.7)], "clId long, `feat#1` double")
    parts = neighbors.graph_dataset(components, nodes, edges, background, 1)
    assert parts["nodes"].columns == ["node_id", "component_id", "node_feat_01"]
    audit = neighbors.graph_dataset_profile(components, nodes, edges, parts)
    row = audit.first()
    assert (row.missing_labeled_nodes, row.duplicate_background_matches) == (1, 1)
    assert (row.missing_target_nodes, row.cross_component_edges, row.null_component_labels) == (1, 1, 1)
    assert (row.hard_failures, row.output_edge_rows, row.dropped_edge_rows) == (5, 1, 2)
    with pytest.raises(IntegrityError):
        stores.enforce(audit, neighbors.GRAPH_GATE)


def test_nodes_are_never_broadcast_to_the_edges(spark, tmp_path):
    """A file of very wide vectors looks small to the planner, which counts a vector as one entry."""
    names = [f"node_feat_{i:02d}" for i in range(1, 44)]
    wide = [(F.col("id") % 7 + i).cast("double").alias(n) for i, n in enumerate(names)]
    spark.range(2000).select(F.col("id").alias("node_id"), F.col("id").alias("component_id"), *wide).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    edges = spark.range(2000).select(F.col("id").alias("source_node_id"), (F.col("id") + 1).alias("target_node_id"))
    for reverse in (False, True):
        found = neighbors.neighbor_mean(nodes, edges, names, reverse)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
