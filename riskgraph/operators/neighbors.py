"""Compact labelled graph, directed neighbour aggregation and pooling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import column, prefixed_features, renamed_features
from riskgraph.operators import linking
from riskgraph.operators.enrich import match_node_features, node_match_audit
from riskgraph.operators.models import FittedLogistic, fit_logistic, train_test
from riskgraph.operators.profile import filtered_counts, one_row
from riskgraph.session import materialize


def graph_nodes(background: DataFrame, nodes: DataFrame, expected: int | None = None) -> DataFrame:
    """Labelled nodes with their features as ``node_feat_NN``."""
    features = prefixed_features(background, expected=expected)
    return match_node_features(background, nodes, features).select(
        "node_id", "component_id", *renamed_features(features, "node_feat")
    )


def graph_dataset(
    components: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    background: DataFrame,
    expected: int | None = None,
) -> dict[str, DataFrame]:
    """The compact graph: ``nodes``, ``edges`` and ``components``."""
    return {
        "nodes": graph_nodes(background, nodes, expected),
        "edges": linking.clean_graph_edges(edges, nodes),
        "components": components.select("component_id", "label"),
    }


def graph_dataset_profile(
    components: DataFrame, nodes: DataFrame, edges: DataFrame, graph: dict[str, DataFrame]
) -> DataFrame:
    """One row with every integrity count of the compact graph and the number of failures."""
    counted_edges = linking.edge_component_map(edges, nodes).agg(
        F.count(F.lit(1)).alias("labeled_edge_rows"),
        F.count_if(F.col("component_id").isNull()).alias("missing_source_nodes"),
        F.count_if(F.col("target_component_id").isNull()).alias("missing_target_nodes"),
        F.count_if(F.col("component_id") != F.col("target_component_id")).alias("cross_component_edges"),
    )
    audit = node_match_audit(nodes, graph["nodes"]).withColumnRenamed(
        "matched_background_rows", "matched_node_rows"
    )
    features = [c for c in graph["nodes"].columns if c.startswith("node_feat_")]
    kept = graph["edges"].agg(F.count(F.lit(1)).alias("output_edge_rows"))
    row = one_row([audit, counted_edges, kept, filtered_counts(components)])
    failing = (
        "missing_labeled_nodes",
        "duplicate_background_matches",
        "missing_source_nodes",
        "missing_target_nodes",
        "cross_component_edges",
        "null_component_labels",
    )
    return row.withColumn("node_feature_count", F.lit(len(features)).cast("long")).withColumns(
        {
            "hard_failures": reduce(lambda a, b: a + b, [F.col(c) for c in failing]),
            "dropped_edge_rows": F.col("labeled_edge_rows") - F.col("output_edge_rows"),
        }
    )


GRAPH_GATE = ("hard_failures", "dropped_edge_rows")


def with_vector(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``node_id, component_id`` and the features as one array of doubles."""
    values = F.array(*[column(f).cast("double") for f in features])
    return nodes.select("node_id", "component_id", values.alias("vector"))


def with_columns(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The entries of ``vector`` as columns again."""
    kept = [c for c in vectors.columns if c != "vector"]
    return vectors.select(*kept, *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(names)])


# A receiver or component of more rows than this is combined in every task before its rows move.
HOT_ROWS = 1_000_000


def _hot_keys(rows: DataFrame, key: str, limit: int | None = None) -> list:
    """Keys of more than ``limit`` rows: at most one key for so many rows reaches the driver."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[key] for r in counted.filter(F.col("n") > (HOT_ROWS if limit is None else limit)).collect()]


def _folded(rows: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame], hot: Sequence) -> DataFrame:
    """``fold`` (an aggregation by ``key``) of rows that move as they are; those of ``hot`` keys are combined first.

    Combined rows are several times as wide, and most keys meet in a task about once.
    """
    if not hot:
        return fold(rows.repartition(key))
    among = reduce(lambda a, b: a | b, [F.col(key).eqNullSafe(F.lit(k)) for k in hot])
    return fold(rows.filter(~among).repartition(key)).unionByName(fold(rows.filter(among)))


def _received_means(
    vectors: DataFrame, edges: DataFrame, vector: Column, width: int, reverse: bool, hot: Sequence
) -> DataFrame:
    """``receiver, mean``: the mean ``vector`` of its senders, for nodes that have any; 0 where all of them have NULL."""
    sender, receiver = "source_node_id", "target_node_id"
    if reverse:
        sender, receiver = receiver, sender
    # The planner counts an array or vector of any width as one entry, and would send the nodes
    # of a large graph to the driver and every executor.
    sent = edges.select(F.col(sender).alias("node_id"), F.col(receiver).alias("receiver")).join(
        vectors.select("node_id", vector.alias("sent")).hint("merge"), "node_id"
    ).select("receiver", "sent")
    means = [F.coalesce(F.avg(F.get("sent", F.lit(i))), F.lit(0.0)) for i in range(width)]
    return _folded(sent, "receiver", lambda rows: rows.groupBy("receiver").agg(F.array(*means).alias("mean")), hot)


def _joined_mean(vectors: DataFrame, means: DataFrame, name: str, width: int) -> DataFrame:
    """``vectors`` with the received mean, zeros where a node received nothing."""
    joined = vectors.join(means, vectors["node_id"] == means["receiver"], "left")
    zeros = F.array_repeat(F.lit(0.0), width)
    return joined.select(*vectors.columns, F.coalesce("mean", zeros).alias(name))


def neighbor_mean(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], reverse: bool = False, prefix: str = "in_"
) -> DataFrame:
    """Per node, the mean of its in-neighbours' features (out-neighbours when ``reverse``).

    A parallel edge counts its source again; a node without neighbours gets 0, and so does a
    feature that is NULL in all of them. The messages of a hub are folded entry by entry before
    the shuffle, so it costs one row per task.
    """
    vectors, width = with_vector(nodes, features), len(features)
    hot = _hot_keys(edges, "source_node_id" if reverse else "target_node_id")
    means = _received_means(vectors, edges, F.col("vector"), width, reverse, hot)
    joined = _joined_mean(vectors.select("node_id", "component_id"), means, "vector", width)
    return with_columns(joined, [f"{prefix}{f}" for f in features])


def khop_parts(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], layers: int = 2
) -> tuple[DataFrame, Column, list[str]]:
    """``node_id, component_id`` and arrays, the vector after ``layers`` hops made of them, and the names of its entries.

    Every hop sets the own, forward and reverse vectors behind each other, so there are
    3**layers entries per feature. The own part of a hop's vector stands in the hop before with
    its means behind it, so a hop sends only what the hop before it added. A hop is written out,
    the last one excepted, so the next one starts from a table.
    """
    if layers < 1:
        raise ValueError("layers must be at least 1")
    hot = {reverse: _hot_keys(edges, "source_node_id" if reverse else "target_node_id") for reverse in (False, True)}
    current, names = with_vector(nodes, features), list(features)
    for hop in range(1, layers + 1):
        width = len(names)
        # What lies before it was sent a hop ago: its means are the second and the last third.
        known = width // 3 if hop > 1 else 0
        sent, joined = F.slice("vector", known + 1, width - known), current
        for name, reverse in (("forward", False), ("backward", True)):
            means = _received_means(current, edges, sent, width - known, reverse, hot[reverse])
            joined = _joined_mean(joined, means, name, width - known)
        vector = F.concat(
            "vector", F.slice("vector", known + 1, known), "forward", F.slice("vector", 2 * known + 1, known), "backward"
        )
        if hop < layers:
            current = materialize(joined.select("node_id", "component_id", vector.alias("vector")), "hop")
        names += [f"{way}{hop}_{n}" for way in ("in", "out") for n in names]
    return joined, vector, names


def khop_vectors(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], layers: int = 2
) -> tuple[DataFrame, list[str]]:
    """``node_id, component_id, vector`` after ``layers`` hops, and the names of the entries."""
    parts, vector, names = khop_parts(nodes, edges, features, layers)
    return parts.select("node_id", "component_id", vector.alias("vector")), names


def khop_dual_channel(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], layers: int = 2
) -> DataFrame:
    """The vectors of ``khop_vectors`` as columns; hop h prefixes them with ``in<h>_`` and ``out<h>_``."""
    return with_columns(*khop_vectors(nodes, edges, features, layers))


def mean_max_vectors(nodes: DataFrame, width: int, vector: Column | None = None, open_width: int | None = None) -> DataFrame:
    """``component_id, vector``: means, then maxima, of each entry of ``vector``; NULL where all nodes have NULL.

    A given ``vector`` is made of columns of ``nodes`` after these have moved. Only the first
    ``open_width`` entries may be NULL (all if not given); each has a flag behind the entries.
    """
    vector = F.col("vector") if vector is None else vector
    open_width = width if open_width is None else open_width
    lowest = float("-inf")
    filled = F.transform(vector, lambda x: F.coalesce(x, F.lit(lowest)))
    present = F.transform(F.slice(vector, 1, open_width), lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    zeros = F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0)))
    aggregates = [
        vector_to_array(Summarizer.mean(array_to_vector(F.concat(zeros, present)))).alias("mean"),
        vector_to_array(Summarizer.max(array_to_vector(filled))).alias("max"),
    ]
    rows = nodes.drop("node_id")
    pooled = _folded(rows, "component_id", lambda some: some.groupBy("component_id").agg(*aggregates), _hot_keys(rows, "component_id"))
    means = F.zip_with(
        F.slice("mean", 1, open_width), F.slice("mean", width + 1, open_width), lambda x, flag: x / F.nullif(flag, F.lit(0.0))
    )
    rest = F.slice("mean", open_width + 1, width - open_width)
    return pooled.select(
        "component_id", F.concat(means, rest, F.transform("max", lambda x: F.nullif(x, F.lit(lowest)))).alias("vector")
    )


def graph_mean_max_pool(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per component, the mean and the maximum of each node feature."""
    pooled = mean_max_vectors(with_vector(nodes, features), len(features))
    return with_columns(pooled, [f"{way}_{f}" for way in ("mean", "max") for f in features])


def graph_component_features(
    graph: dict[str, DataFrame], features: Sequence[str], layers: int = 2
) -> DataFrame:
    """Pooled hop features for every labelled component, 0 for one without nodes."""
    parts, vector, names = khop_parts(graph["nodes"], graph["edges"], features, layers)
    pooled = with_columns(mean_max_vectors(parts, len(names), vector, len(features)), [f"{way}_{n}" for way in ("mean", "max") for n in names])
    labelled = graph["components"].filter("label IS NOT NULL")
    return labelled.join(pooled, "component_id", "left").fillna(0.0)


def graph_feature_classifier(
    graph: dict[str, DataFrame],
    features: Sequence[str],
    layers: int = 2,
    fraction: float = 0.20,
    seed: int = 42,
) -> tuple[FittedLogistic, DataFrame]:
    """Fixed propagation, pooling, and a logistic classifier; returns it with the test scores."""
    store = materialize(graph_component_features(graph, features, layers), "graph_store")
    train, test = train_test(store, fraction, seed)
    model = fit_logistic(train)
    return model, model.score(test).withColumn("model", F.lit("neighbor_aggregation"))
