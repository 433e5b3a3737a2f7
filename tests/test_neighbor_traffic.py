"""What neighbour means, hops and pooling send and write, and that it does not change their values."""

import re

import pytest

from riskgraph.operators import neighbors

NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def graph(spark):
    """Nodes of ten components, some values NULL, one node listed twice, one hub, an edge to nowhere and one from NULL."""
    nodes = [(i, i % 10 if i else None, None if i % 4 == 0 else float(i), None if i % 20 == 3 else i / 7) for i in range(60)]
    nodes.append(nodes[12])
    edges = [(i, (i * 7) % 60) for i in range(60)] + [(i, 5) for i in range(40)] + [(5, i) for i in range(30)] + [(3, 999), (None, 4), (4, None)]
    components = [(i, i % 2) for i in range(12)]
    return {
        "nodes": spark.createDataFrame(nodes, "node_id long, component_id long, x double, y double"),
        "edges": spark.createDataFrame(edges, "source_node_id long, target_node_id long"),
        "components": spark.createDataFrame(components, "component_id long, label int"),
    }


def means(vectors, pairs, width):
    """By node, the mean of its senders' entries that are there, 0 without any."""
    sent = {}
    for sender, receiver in pairs:
        sent.setdefault(receiver, []).extend(vectors.get(sender, []) if sender is not None else [])
    out = {}
    for node in vectors:
        columns = [[v[i] for v in sent.get(node, []) if v[i] is not None] for i in range(width)]
        out[node] = [sum(c) / len(c) if c else 0.0 for c in columns]
    return out


def expected_hops(graph, layers):
    rows, edges = graph["nodes"].collect(), [tuple(r) for r in graph["edges"].collect()]
    current = {}
    for r in rows:
        current.setdefault(r.node_id, []).append([r.x, r.y])
    for _ in range(layers):
        width = len(next(iter(current.values()))[0])
        forward, backward = means(current, edges, width), means(current, [(b, a) for a, b in edges], width)
        current = {n: [v + forward[n] + backward[n] for v in vs] for n, vs in current.items()}
    return current


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_hops_are_those_of_whole_vectors(graph, monkeypatch, hot):
    monkeypatch.setattr(neighbors, "HOT_ROWS", hot)
    for layers in (1, 2, 3):
        wanted = expected_hops(graph, layers)
        found = neighbors.khop_dual_channel(graph["nodes"], graph["edges"], NAMES, layers).collect()
        assert len(found) == 61
        for r in found:
            values = wanted[r.node_id][0]
            assert [v is None for v in list(r)[2:]] == [v is None for v in values]
            assert [v or 0.0 for v in list(r)[2:]] == pytest.approx([v or 0.0 for v in values], rel=1e-9)


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_pooled_hops_are_means_and_maxima_of_the_nodes(graph, monkeypatch, hot):
    monkeypatch.setattr(neighbors, "HOT_ROWS", hot)
    vectors, names = neighbors.khop_vectors(graph["nodes"], graph["edges"], NAMES, 2)
    by_component = {}
    for r in vectors.collect():
        by_component.setdefault(r.component_id, []).append(r.vector)
    found = {r.component_id: r for r in neighbors.graph_component_features(graph, NAMES, 2).collect()}
    assert sorted(found) == list(range(12)) and set(list(found[11])[2:]) == {0.0}
    for component in range(10):
        for i, name in enumerate(names):
            values = [v[i] for v in by_component[component] if v[i] is not None]
            assert found[component][f"mean_{name}"] == pytest.approx(sum(values) / len(values) if values else 0.0)
            assert found[component][f"max_{name}"] == pytest.approx(max(values) if values else 0.0)


def test_the_last_hop_is_not_written(graph, monkeypatch):
    written, write = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert neighbors.khop_dual_channel(graph["nodes"], graph["edges"], NAMES, 2).count() == 61
    assert written == ["hop"]


def test_a_hop_sends_only_what_the_hop_before_added(graph):
    """Of the six entries of a hop, the second one sends four: each has a mean, in both directions."""
    plan = neighbors.khop_dual_channel(graph["nodes"], graph["edges"], NAMES, 2)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = re.findall(r"Aggregate \[receiver#\d+L?\].*", plan)
    assert [line.count("avg(") for line in aggregates] == [4, 4]


def test_rows_move_before_they_are_combined(graph):
    """Combined rows are wider than plain ones: the exchange by receiver or component stands below every aggregation by it."""
    for df, key in (
        (neighbors.neighbor_mean(graph["nodes"], graph["edges"], NAMES), "receiver"),
        (neighbors.graph_mean_max_pool(graph["nodes"], NAMES), "component_id"),
    ):
        lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        partial = next(i for i, line in enumerate(lines) if f"HashAggregate(keys=[{key}" in line and "partial_" in line)
        exchange = next(i for i, line in enumerate(lines) if f"hashpartitioning({key}" in line)
        assert partial < exchange
