"""Structural features of connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.linking import written_valid_edges

# Order of the structural store.
COUNT_COLUMNS = (
    "node_count",
    "edge_count",
    "transaction_count",
    "unique_directed_pairs",
    "self_loop_count",
)
DEGREE_COLUMNS = tuple(
    f"{stat}_{side}_degree" for side in ("in", "out", "total") for stat in ("avg", "max", "sd")
)
ROLE_COLUMNS = ("source_nodes", "sink_nodes", "isolate_nodes")
RATIO_COLUMNS = ("edges_per_node", "directed_density")
STRUCTURAL_COLUMNS = COUNT_COLUMNS + DEGREE_COLUMNS + ROLE_COLUMNS + RATIO_COLUMNS


def edge_multiplicity(valid: DataFrame) -> DataFrame:
    """Number of rows per component, endpoint pair and transaction.

    Every edge statistic starts from this one shuffle. Its key is the whole edge, so on a
    table that is not partitioned by an endpoint already, as written_valid_edges gives, a
    component or node with a large share of all edges is spread over all tasks.
    """
    return valid.groupBy("component_id", "source_node_id", "target_node_id", "transaction_id").agg(
        F.count(F.lit(1)).alias("edges")
    )


def pair_multiplicity(multiplicity: DataFrame) -> DataFrame:
    return multiplicity.groupBy("component_id", "source_node_id", "target_node_id").agg(
        F.sum("edges").alias("edges")
    )


def unique_directed_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs, and self-loop edges, per component."""
    loop = F.when(F.col("source_node_id") == F.col("target_node_id"), F.col("edges")).otherwise(0)
    return pairs.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("unique_directed_pairs"), F.sum(loop).alias("self_loop_count")
    )


def transaction_stats(multiplicity: DataFrame) -> DataFrame:
    """Edges and distinct transactions per component (two steps, so no wide distinct)."""
    return (
        multiplicity.groupBy("component_id", "transaction_id")
        .agg(F.sum("edges").alias("edges"))
        .groupBy("component_id")
        .agg(
            F.sum("edges").alias("edge_count"),
            # As a distinct count, a NULL transaction adds an edge but no transaction.
            F.count("transaction_id").alias("transaction_count"),
        )
    )


def component_edge_stats(valid: DataFrame) -> DataFrame:
    """Edges, distinct transactions and self-loops per component."""
    multiplicity = edge_multiplicity(valid)
    loops = unique_directed_pairs(pair_multiplicity(multiplicity))
    return transaction_stats(multiplicity).join(
        loops.select("component_id", "self_loop_count"), "component_id"
    )


def _edge_ends(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both ends: out-degree at the source, in-degree at the target."""
    at_source = pairs.select(
        "component_id",
        F.col("source_node_id").alias("node_id"),
        F.lit(0).cast("long").alias("in_degree"),
        F.col("edges").alias("out_degree"),
    )
    at_target = pairs.select(
        "component_id",
        F.col("target_node_id").alias("node_id"),
        F.col("edges").alias("in_degree"),
        F.lit(0).cast("long").alias("out_degree"),
    )
    return at_source.unionByName(at_target)


def in_out_degree(pairs: DataFrame) -> DataFrame:
    """In- and out-degree of every node that has an edge; parallel edges count."""
    return (
        _edge_ends(pairs)
        .groupBy("component_id", "node_id")
        .agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    )


def node_degree(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """In-, out- and total degree of every listed node, 0 when it has no edge.

    Nodes and edge ends are summed in one aggregation instead of two joins. A node listed
    several times in a component keeps its number of rows.
    """
    listed = nodes.select(
        "component_id",
        "node_id",
        F.lit(0).cast("long").alias("in_degree"),
        F.lit(0).cast("long").alias("out_degree"),
        F.lit(1).alias("copies"),
    )
    ends = _edge_ends(pairs).withColumn("copies", F.lit(0))
    return (
        listed.unionByName(ends)
        .groupBy("component_id", "node_id")
        .agg(
            F.sum("in_degree").alias("in_degree"),
            F.sum("out_degree").alias("out_degree"),
            F.sum("copies").cast("int").alias("copies"),
        )
        .select(
            "component_id",
            "node_id",
            "in_degree",
            "out_degree",
            (F.col("in_degree") + F.col("out_degree")).alias("total_degree"),
            F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )


def component_degree_stats(degrees: DataFrame) -> DataFrame:
    """Node count, degree statistics and node roles per component."""
    stats = []
    for side in ("in", "out", "total"):
        name = f"{side}_degree"
        stats += [
            F.avg(name).alias(f"avg_{name}"),
            F.max(name).alias(f"max_{name}"),
            F.stddev_pop(name).alias(f"sd_{name}"),
        ]
    no_in, no_out = F.col("in_degree") == 0, F.col("out_degree") == 0
    return degrees.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        *stats,
        F.count_if(no_in & ~no_out).alias("source_nodes"),
        F.count_if(no_out & ~no_in).alias("sink_nodes"),
        F.count_if(no_in & no_out).alias("isolate_nodes"),
    )


def zero_fill(df: DataFrame, columns) -> DataFrame:
    """NULL becomes 0 in the named columns; NaN is left as it is."""
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns}
    return df.withColumns(filled)


def safe_ratios(df: DataFrame) -> DataFrame:
    """Edges per node and directed density, 0 where the divisor would be 0."""
    n = F.col("node_count")
    return df.withColumns(
        {
            "edges_per_node": F.when(n > 0, F.col("edge_count").cast("double") / n).otherwise(0.0),
            "directed_density": F.when(
                n > 1, F.col("unique_directed_pairs").cast("double") / (n * (n - 1))
            ).otherwise(0.0),
        }
    )


def assemble_component_store(
    components: DataFrame, node_stats: DataFrame, edge_stats: DataFrame, pair_stats: DataFrame
) -> DataFrame:
    """Labelled components with all structural columns, 0 where nothing was found.

    The three right sides leave their aggregations already partitioned by component, so only
    the component table moves.
    """
    joined = (
        components.filter("label IS NOT NULL")
        .join(node_stats, "component_id", "left")
        .join(edge_stats, "component_id", "left")
        .join(pair_stats, "component_id", "left")
    )
    filled = zero_fill(joined, COUNT_COLUMNS + DEGREE_COLUMNS + ROLE_COLUMNS)
    return safe_ratios(filled).select("component_id", "label", *STRUCTURAL_COLUMNS)


def component_structural_features(
    components: DataFrame, nodes: DataFrame, edges: DataFrame
) -> DataFrame:
    """Nineteen structural features per labelled component, from edges written once."""
    multiplicity = edge_multiplicity(written_valid_edges(edges, nodes))
    pairs = pair_multiplicity(multiplicity)
    return assemble_component_store(
        components,
        component_degree_stats(node_degree(nodes, pairs)),
        transaction_stats(multiplicity),
        unique_directed_pairs(pairs),
    )


# The short variant for canonical tables: nodes (component_id, node_id) and
# edges (component_id, source, target). Ids may be numbers or text.


def simple_edge_stats(edges: DataFrame) -> DataFrame:
    """Edges, mean in/out degree over nodes that have one, and largest total degree, from one read of the edges."""
    end = F.explode(
        F.array(
            F.struct(F.col("source").alias("node_id"), F.lit(0).alias("ins"), F.lit(1).alias("outs")),
            F.struct(F.col("target").alias("node_id"), F.lit(1).alias("ins"), F.lit(0).alias("outs")),
        )
    )
    per_node = (
        edges.select("component_id", end.alias("end"))
        .groupBy("component_id", F.col("end.node_id").alias("node_id"))
        .agg(F.sum("end.ins").alias("ins"), F.sum("end.outs").alias("outs"))
    )
    named = F.col("node_id").isNotNull()
    return per_node.groupBy("component_id").agg(
        # Every edge leaves one end, whether its node is known or not.
        F.sum("outs").alias("edge_count"),
        F.coalesce(F.avg(F.when(named & (F.col("ins") > 0), F.col("ins"))), F.lit(0.0)).alias("mean_in_degree"),
        F.coalesce(F.avg(F.when(named & (F.col("outs") > 0), F.col("outs"))), F.lit(0.0)).alias("mean_out_degree"),
        F.max(F.when(named, F.col("ins") + F.col("outs"))).alias("max_degree"),
    )


def distinct_node_counts(nodes: DataFrame) -> DataFrame:
    return (
        nodes.select("component_id", "node_id")
        .distinct()
        .groupBy("component_id")
        .agg(F.count("node_id").alias("node_count"))
    )


def count_outer_align(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes and edges per component, for components in either table."""
    edge_counts = edges.groupBy("component_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return zero_fill(
        distinct_node_counts(nodes).join(edge_counts, "component_id", "full_outer"), ("node_count", "edge_count")
    )


def simple_structural_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, mean degrees, largest degree and edge-count density per component."""
    n = F.greatest(F.col("node_count"), F.lit(1))
    possible = n * (n - 1)
    joined = distinct_node_counts(nodes).join(simple_edge_stats(edges), "component_id", "full_outer")
    counted = ("node_count", "edge_count", "mean_in_degree", "mean_out_degree", "max_degree")
    filled = zero_fill(joined, counted)
    return filled.withColumn(
        "density", F.col("edge_count") / F.when(possible == 0, 1).otherwise(possible)
    )


def derived_signals(features: DataFrame) -> DataFrame:
    """Two combined signals: weighted size and degree, and edges per node."""
    return features.withColumns(
        {
            "flow_dispersion": F.col("node_count") * 0.4 + F.col("max_degree") * 0.7,
            "path_complexity": F.col("edge_count") / F.greatest(F.col("node_count"), F.lit(1)),
        }
    )


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("component_id", "label"), "component_id")
