"""Enrichment runs from match to coverage, and gates that stop them."""

import pytest

from riskgraph.errors import IntegrityError
from riskgraph.plans import enrichment
from riskgraph.session import new_scratch_path

# More than two passes of eleven features.
FEATURES = [f"feat#{i}" for i in range(1, 26)]


@pytest.fixture()
def store(spark):
    return spark.createDataFrame([(10, 1), (20, 0), (30, 0)], "component_id long, label int")


@pytest.fixture()
def nodes(spark):
    return spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "node_id long, component_id long")


def wide(spark, keys, names):
    schema = ", ".join([f"{n} long" for n in names] + [f"`{f}` double" for f in FEATURES])
    return spark.createDataFrame([(*k, *[float(k[0] * i) for i in range(25)]) for k in keys], schema)


def test_node_run_covers_every_feature(spark, store, nodes):
    run = enrichment.enrich_nodes(store, nodes, wide(spark, [(1,), (2,), (3,), (9,)], ["clId"]), 25)
    rows = {r.component_id: r for r in run.store.collect()}
    assert len(run.store.columns) == 2 + 1 + 4 * 25
    assert rows[10].matched_node_count == 2 and rows[10].node_feat_25_mean == 36.0
    assert rows[20].node_feat_25_max == 72.0 and rows[30].node_feat_25_max is None
    coverage = run.coverage.first()
    assert (coverage.output_component_rows, coverage.components_without_features) == (3, 1)
    assert run.audit.first().missing_labeled_nodes == 0


def test_node_run_stops_at_its_gate_and_leaves_the_audit(spark, store, nodes):
    path = new_scratch_path(spark, "audit")
    with pytest.raises(IntegrityError, match="missing_labeled_nodes"):
        enrichment.enrich_nodes(store, nodes, wide(spark, [(1,), (2,)], ["clId"]), 25, path)
    assert spark.read.json(path).first().missing_labeled_nodes == 1


def test_edge_run_fills_components_without_edges(spark, store, nodes):
    names = ["source_node_id", "target_node_id", "transaction_id"]
    edges = spark.createDataFrame([(1, 2, 7), (3, 3, 8)], ", ".join(f"{n} long" for n in names))
    background = wide(spark, [(1, 2, 7), (3, 3, 8), (5, 6, 9)], ["clId1", "clId2", "txId"])
    run = enrichment.enrich_edges(store, nodes, edges, background, 25)
    rows = {r.component_id: r for r in run.store.collect()}
    assert rows[20].edge_feat_25_min == 72.0 and rows[10].matched_edge_count == 1
    assert rows[30].matched_edge_count == 0 and rows[30].edge_feat_01_mean == 0.0
    assert run.coverage.first().rows_with_null_aggregates == 0


def test_edge_run_stops_on_repeated_keys(spark, store, nodes):
    names = ["source_node_id", "target_node_id", "transaction_id"]
    edges = spark.createDataFrame([(1, 2, 7), (1, 2, 7)], ", ".join(f"{n} long" for n in names))
    with pytest.raises(IntegrityError, match="duplicate_labeled_edge_keys"):
        enrichment.enrich_edges(store, nodes, edges, wide(spark, [(1, 2, 7)], ["clId1", "clId2", "txId"]), 25)
    doubled = store.union(store)
    with pytest.raises(IntegrityError):
        enrichment.enrich_edges(doubled, nodes, edges, wide(spark, [(1, 2, 7)], ["clId1", "clId2", "txId"]), 25)
