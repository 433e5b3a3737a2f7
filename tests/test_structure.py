"""Structural features and integrity checks on hand-written graphs."""

import statistics

import pytest

from riskgraph.errors import IntegrityError
from riskgraph.operators import linking, structure

# Component 1: path with a parallel edge and a self-loop. 2: two-way pair with both
# self-loops. 3: one node, self-loop only. 4: no nodes. 5: nodes without edges. 6: no label.
COMPONENTS = [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1), (6, None)]
NODES = [(11, 1), (12, 1), (13, 1), (14, 1), (21, 2), (22, 2), (31, 3), (51, 5), (52, 5), (61, 6)]
EDGES = [
    (11, 12, 100), (11, 12, 101), (12, 13, 101), (12, 12, 102),
    (21, 22, 200), (22, 21, 201), (21, 21, 202), (22, 22, 203),
    (31, 31, 300),
    (11, 21, 400),  # crosses components
    (11, 99, 401), (98, 11, 402), (98, 99, 403),  # unknown endpoints
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(COMPONENTS, "component_id long, label int"),
        spark.createDataFrame(NODES, "node_id long, component_id long"),
        spark.createDataFrame(
            EDGES, "source_node_id long, target_node_id long, transaction_id long"
        ),
    )


def by_id(df):
    return {r.component_id: r.asDict() for r in df.collect()}


def expected_row(component):
    nodes = [n for n, c in NODES if c == component]
    edges = [e for e in EDGES if e[0] in nodes and e[1] in nodes]
    ins = [sum(e[1] == n for e in edges) for n in nodes]
    outs = [sum(e[0] == n for e in edges) for n in nodes]
    both = [i + o for i, o in zip(ins, outs)]
    row = {
        "node_count": len(nodes),
        "edge_count": len(edges),
        "transaction_count": len({e[2] for e in edges}),
        "unique_directed_pairs": len({e[:2] for e in edges}),
        "self_loop_count": sum(e[0] == e[1] for e in edges),
        "source_nodes": sum(i == 0 and o > 0 for i, o in zip(ins, outs)),
        "sink_nodes": sum(o == 0 and i > 0 for i, o in zip(ins, outs)),
        "isolate_nodes": sum(b == 0 for b in both),
    }
    for side, values in (("in", ins), ("out", outs), ("total", both)):
        row[f"avg_{side}_degree"] = statistics.fmean(values) if values else 0.0
        row[f"max_{side}_degree"] = max(values, default=0)
        row[f"sd_{side}_degree"] = statistics.pstdev(values) if values else 0.0
    n = len(nodes)
    row["edges_per_node"] = len(edges) / n if n else 0.0
    row["directed_density"] = row["unique_directed_pairs"] / (n * (n - 1)) if n > 1 else 0.0
    return row


def test_structural_features(tables):
    found = by_id(structure.component_structural_features(*tables))
    assert sorted(found) == [1, 2, 3, 4, 5]
    for component, label in COMPONENTS[:5]:
        row = found[component]
        assert row["label"] == label
        for name, value in expected_row(component).items():
            assert row[name] == pytest.approx(value), (component, name)
    assert found[2]["directed_density"] == 2.0


def test_store_column_order(tables):
    df = structure.component_structural_features(*tables)
    assert df.columns == ["component_id", "label", *structure.STRUCTURAL_COLUMNS]
    assert len(structure.STRUCTURAL_COLUMNS) == 19


def test_repeated_node_rows_are_kept(spark, tables):
    components, _, _ = tables
    nodes = spark.createDataFrame([(11, 1), (11, 1), (12, 1)], "node_id long, component_id long")
    pairs = spark.createDataFrame(
        [(1, 11, 12, 1)], "component_id long, source_node_id long, target_node_id long, edges long"
    )
    assert structure.node_degree(nodes, pairs).count() == 3


def test_integrity_counts(tables):
    components, nodes, edges = tables
    assert linking.missing_endpoints(edges, nodes).first() == (2, 2)
    assert linking.cross_component_edges(edges, nodes).count() == 1
    assert linking.clean_graph_edges(edges, nodes).count() == 9
    assert linking.unknown_references(components.filter("component_id < 6"), nodes, edges).first() == (1, 3)


def test_universe_and_test_set_comparison(spark):
    a = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "component_id long, label int")
    b = spark.createDataFrame([(2, 1), (3, None), (4, 0)], "component_id long, label int")
    assert linking.universe_match(a, b).first() == (1, 1, 1)
    assert linking.matched_test_audit(a, a).first().exact_match
    assert not linking.matched_test_audit(a, b).first().exact_match


def test_many_to_one_join_gates(spark):
    queue = spark.createDataFrame([(1,), (2,)], "component_id long")
    stats = spark.createDataFrame([(1, 5), (2, 6)], "component_id long, n long")
    assert linking.join_stats_many_to_one(queue, stats).count() == 2
    with pytest.raises(IntegrityError):
        linking.join_stats_many_to_one(queue, stats.union(stats))
    with pytest.raises(IntegrityError):
        linking.join_stats_many_to_one(queue, stats.filter("component_id = 1"))


def test_node_in_two_components_is_found(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2)], "node_id long, component_id long")
    with pytest.raises(IntegrityError):
        linking.require_unique(nodes, ["node_id"])


def test_simple_variant_on_text_ids(spark):
    nodes = spark.createDataFrame(
        [("A", "a"), ("A", "b"), ("A", "c"), ("B", "x"), ("C", "y"), ("C", "z")],
        "component_id string, node_id string",
    )
    edges = spark.createDataFrame(
        [("A", "a", "b"), ("A", "b", "c"), ("C", "y", "z"), ("C", "y", "z"), ("D", "q", "r")],
        "component_id string, source string, target string",
    )
    found = by_id(structure.simple_structural_features(nodes, edges))
    path = found["A"]
    assert (path["node_count"], path["edge_count"], path["max_degree"]) == (3, 2, 2)
    assert path["mean_in_degree"] == path["mean_out_degree"] == 1.0
    assert path["density"] == pytest.approx(2 / 6)
    assert found["B"]["density"] == 0.0 and found["B"]["max_degree"] == 0
    assert found["C"]["mean_out_degree"] == 2.0 and found["C"]["density"] == 1.0
    assert (found["D"]["node_count"], found["D"]["edge_count"], found["D"]["density"]) == (0, 1, 1.0)
    signals = by_id(structure.derived_signals(structure.simple_structural_features(nodes, edges)))
    assert signals["A"]["flow_dispersion"] == pytest.approx(3 * 0.4 + 2 * 0.7)
    assert signals["D"]["path_complexity"] == 1.0
