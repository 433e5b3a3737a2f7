"""Endpoint look-ups and referential integrity.

Joins carry no broadcast hint: node and edge tables both grow with the data, so the planner
decides on measured sizes. The many-rows side is always on the left of a left or inner
join, the side adaptive execution may split when one endpoint holds a large share of edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.session import materialize


def _by_source(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("source_node_id"), "component_id")


def _by_target(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("node_id").alias("target_node_id"), F.col("component_id").alias("target_component_id")
    )


def edge_component_map(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the component of each endpoint, NULL where the node is unknown."""
    return edges.join(_by_source(nodes), "source_node_id", "left").join(
        _by_target(nodes), "target_node_id", "left"
    )


def valid_edges(mapped: DataFrame) -> DataFrame:
    """Mapped edges whose two endpoints share one known component."""
    return mapped.filter("component_id IS NOT NULL AND target_component_id = component_id")


def written_valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The valid edges as a written table.

    An aggregation straight on the join would need the join's partitioning, and adaptive
    execution may then not split a node that ends a large share of all edges. A write needs
    no partitioning, so both look-ups can be split, and each runs once.
    """
    return materialize(valid_edges(edge_component_map(edges, nodes)), "valid-edges")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges without a known source, and edges without a known target.

    Ends and nodes meet in one aggregation keyed on the node, which each task combines first;
    an end without an id is never known.
    """
    end = F.explode(
        F.array(
            F.struct(F.col("source_node_id").alias("node_id"), F.lit(1).alias("sources"), F.lit(0).alias("targets")),
            F.struct(F.col("target_node_id").alias("node_id"), F.lit(0).alias("sources"), F.lit(1).alias("targets")),
        )
    )
    ends = edges.select(end.alias("end")).select("end.*", F.lit(0).alias("known"))
    known = nodes.filter("node_id IS NOT NULL").select(
        "node_id", F.lit(0).alias("sources"), F.lit(0).alias("targets"), F.lit(1).alias("known")
    )
    per_node = ends.unionByName(known).groupBy("node_id").agg(
        F.sum("sources").alias("sources"), F.sum("targets").alias("targets"), F.max("known").alias("known")
    )
    unknown = F.col("known") == 0
    return per_node.agg(
        *[
            F.coalesce(F.sum(F.when(unknown, F.col(c))), F.lit(0)).alias(f"missing_{c[:-1]}_nodes")
            for c in ("sources", "targets")
        ]
    )


def _both_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(_by_source(nodes), "source_node_id").join(_by_target(nodes), "target_node_id")


def cross_component_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with two known endpoints in different components."""
    return _both_known(edges, nodes).filter("component_id <> target_component_id")


def clean_graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside one component, with that component."""
    return (
        _both_known(edges, nodes)
        .filter("component_id = target_component_id")
        .select("transaction_id", "source_node_id", "target_node_id", "component_id")
    )


def unknown_references(components: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes in unknown components, and edges with an unknown endpoint."""
    lost_nodes = nodes.join(components.select("component_id"), "component_id", "left_anti")
    known = edge_component_map(edges, nodes.withColumn("component_id", F.lit(1)))
    lost_edges = known.filter("component_id IS NULL OR target_component_id IS NULL")
    return (
        lost_nodes.select(F.lit("node").alias("kind"))
        .unionByName(lost_edges.select(F.lit("edge").alias("kind")))
        .agg(
            F.count_if(F.col("kind") == "node").alias("nodes_with_unknown_component"),
            F.count_if(F.col("kind") == "edge").alias("edges_with_unknown_node"),
        )
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values on more than one row, with their row count."""
    return df.groupBy(*keys).count().filter("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise IntegrityError(f"duplicate values in {list(keys)}")
    return df


def join_stats_many_to_one(queue: DataFrame, stats: DataFrame, key: str = "component_id") -> DataFrame:
    """Left join that fails on a repeated key in ``stats`` or a queue row without a match."""
    require_unique(stats, [key])
    if not queue.join(stats, key, "left_anti").isEmpty():
        raise IntegrityError(f"queue rows without a match on {key}")
    return queue.join(stats, key, "left")


def universe_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row comparing two (component_id, label) sets: only left, only right, labels differ."""
    a = left.select("component_id", F.lit(1).alias("in_left"), F.col("label").alias("left_label"))
    b = right.select("component_id", F.lit(1).alias("in_right"), F.col("label").alias("right_label"))
    both = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return a.join(b, "component_id", "full_outer").agg(
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
        F.count_if(both & ~F.col("left_label").eqNullSafe(F.col("right_label"))).alias(
            "label_mismatches"
        ),
    )


def matched_test_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: are the component ids of two test sets the same set?"""
    a = left.select("component_id").distinct().withColumn("in_left", F.lit(1))
    b = right.select("component_id").distinct().withColumn("in_right", F.lit(1))
    counted = a.join(b, "component_id", "full_outer").agg(
        F.count("in_left").alias("left_components"),
        F.count("in_right").alias("right_components"),
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
    )
    return counted.withColumn("exact_match", (F.col("only_left") + F.col("only_right")) == 0)
