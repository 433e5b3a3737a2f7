"""Counts and summaries of labels, nodes, edges, stores and queues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import clean_text, column, numeric_features, target_like
from riskgraph.operators import wide
from riskgraph.operators.linking import edge_component_map


def label_counts(raw_components: DataFrame) -> DataFrame:
    """Components per cleaned raw label, largest first."""
    return (
        raw_components.groupBy(clean_text(F.col("ccLabel")).alias("label"))
        .agg(F.count(F.lit(1)).alias("components"))
        .orderBy(F.desc("components"), "label")
    )


def component_node_counts(raw_components: DataFrame, raw_nodes: DataFrame) -> DataFrame:
    """Every component with its cleaned label and node count, 0 when it has none."""
    counts = raw_nodes.groupBy("ccId").agg(F.count(F.lit(1)).alias("node_count"))
    return raw_components.join(counts, "ccId", "left").select(
        F.col("ccId").alias("component_id"),
        clean_text(F.col("ccLabel")).alias("label"),
        F.coalesce("node_count", F.lit(0)).alias("node_count"),
    )


# One over this is the relative rank error of approximate medians.
MEDIAN_ACCURACY = 10_000


def node_count_by_label(
    raw_components: DataFrame, raw_nodes: DataFrame, accuracy: int = MEDIAN_ACCURACY
) -> DataFrame:
    """Components and their node-count range per cleaned label; the median's rank errs by rows / ``accuracy``."""
    return (
        component_node_counts(raw_components, raw_nodes)
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.min("node_count").alias("min_nodes"),
            F.percentile_approx("node_count", 0.5, accuracy).cast("double").alias("median_nodes"),
            F.avg("node_count").alias("avg_nodes"),
            F.max("node_count").alias("max_nodes"),
        )
        .orderBy(F.desc("components"), "label")
    )


def edge_mapping_quality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges with a missing source, a missing target, or two different components."""
    return edge_component_map(edges, nodes).agg(
        F.count_if(F.col("component_id").isNull()).alias("missing_source_nodes"),
        F.count_if(F.col("target_component_id").isNull()).alias("missing_target_nodes"),
        F.count_if(F.col("component_id") != F.col("target_component_id")).alias(
            "cross_component_edges"
        ),
    )


def store_label_counts(store: DataFrame) -> DataFrame:
    return store.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 1).alias("positive_rows"),
        F.count_if(F.col("label") == 0).alias("negative_rows"),
        F.count_if(F.col("label").isNull()).alias("null_labels"),
    )


def store_summary_by_label(store: DataFrame, accuracy: int = MEDIAN_ACCURACY) -> DataFrame:
    """Eleven statistics per label; the ranks of the two medians err by rows / ``accuracy``."""

    def median(name: str):
        return F.percentile_approx(name, 0.5, accuracy).cast("double").alias(f"median_{name}")

    return (
        store.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.avg("node_count").alias("avg_node_count"),
            median("node_count"),
            F.max("node_count").alias("max_node_count"),
            F.avg("edge_count").alias("avg_edge_count"),
            median("edge_count"),
            F.max("edge_count").alias("max_edge_count"),
            F.avg("edges_per_node").alias("avg_edges_per_node"),
            F.avg("directed_density").alias("avg_directed_density"),
            F.avg("source_nodes").alias("avg_source_nodes"),
            F.avg("sink_nodes").alias("avg_sink_nodes"),
        )
        .orderBy("label")
    )


def null_counts(store: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """NULLs per feature column, one row per feature."""
    names = [c for c in store.columns if c not in ("component_id", "label")]
    names = list(features) if features is not None else names
    nulls = F.count_if(wide.VALUE).alias("nulls")
    counted = wide.per_feature(store, names, [nulls], of=Column.isNull)
    return counted.select("feature", F.coalesce("nulls", F.lit(0)).alias("nulls"))


def column_coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ordinal, name and non-NULL rows of the given columns."""
    filled = F.count_if(wide.VALUE).alias("filled")
    counted = wide.per_feature(df, names, [filled], of=Column.isNotNull)
    return counted.select(
        (F.col(wide.PLACE) + 1).cast("long").alias("ordinal"),
        "feature",
        F.coalesce("filled", F.lit(0)).alias("non_null_rows"),
    )


def target_name_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns whose name hints at a leaked target, with how many rows they fill."""
    return column_coverage(df, names).filter(target_like(F.col("feature")))


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables with different columns side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(column(c)).alias(c) for c in stacked.columns])


def nonfinite_count(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinite cells over all feature columns, in one pass."""
    value = F.col(wide.VALUE)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return wide.cells(df, features).agg(F.count_if(bad).alias("nonfinite_values"))


def filtered_counts(components: DataFrame) -> DataFrame:
    """Rows, positives and NULL labels of a component table."""
    return components.agg(
        F.count(F.lit(1)).alias("component_rows"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("positive_components"),
        F.count_if(F.col("label").isNull()).alias("null_component_labels"),
    )


def store_qa(store: DataFrame) -> DataFrame:
    """Long table of checks: rows, missing ids, ids on several rows, and rows per label."""
    per_id = store.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("n"),
    )
    ids = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("component_id").isNull(), F.col("n"))), F.lit(0)).alias(
            "missing_component_id"
        ),
        F.coalesce(F.sum(F.when(F.col("component_id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias(
            "duplicate_component_ids"
        ),
    )
    checks = ids.unpivot(
        [], ["row_count", "missing_component_id", "duplicate_component_ids"], "check", "n"
    )
    labels = store.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    named = labels.select(
        F.concat(F.lit("label_"), F.coalesce(F.col("label").cast("string"), F.lit("null"))).alias("check"),
        "n",
    )
    return checks.unionByName(named)


def queue_qa(queue: DataFrame) -> DataFrame:
    """Rows, distinct components and score range of a review queue."""
    return (
        queue.groupBy("component_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("risk_score").alias("low"),
            F.max("risk_score").alias("high"),
        )
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("component_id").alias("distinct_components"),
            F.min("low").alias("min_score"),
            F.max("high").alias("max_score"),
        )
    )


def leakage_audit(store: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, classes, features, repeated ids, non-finite cells, suspicious names."""
    names = list(features) if features is not None else numeric_features(store)
    per_id = store.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    )
    ids = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positive_rows"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_rows"),
        F.lit(len(names)).cast("long").alias("feature_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_component_ids"),
    )
    cells = nonfinite_count(store, names).withColumnRenamed(
        "nonfinite_values", "nonfinite_feature_values"
    )
    leaked = F.filter(F.array(*[F.lit(c) for c in names]), target_like)
    return one_row([ids, cells]).withColumn(
        "potential_target_name_columns", F.array_join(leaked, ",")
    )
