"""Features of a small labelled key set, fetched from very large background tables.

The background table is scanned once and only its key and feature columns are read. The
labelled keys are counted before the join: up to ``BROADCAST_ROWS`` keys (a few hundred
megabytes at most) they are sent to every executor and the background table never moves.
Beyond that a bit sketch of the keys, of at most ``SKETCH_ROWS`` short rows, is sent instead:
it drops the background rows whose key is in no labelled set (all but a few in a hundred, up
to some 40 million keys) before both sides are shuffled on the key. Adaptive execution may split a hot key there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import column

# Three long columns and hash-table overhead come to roughly 100 bytes a row.
BROADCAST_ROWS = 4_000_000

NODE_KEY = ("node_id",)
EDGE_KEY = ("source_node_id", "target_node_id", "transaction_id")

# Four statistics take seven aggregation columns; beyond 100 columns Spark leaves its
# whole-stage code, which made one 172-column aggregation 1.6 times slower.
FEATURES_PER_PASS = 11

# A component with more matched rows than this is combined in every task before its rows move.
HOT_ROWS = 1_000_000

# The four statistics of each feature.
STATISTICS = (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))


# Rows of a key sketch, at most, each a number and 64 bits, and bits for each key below that.
SKETCH_ROWS = 2**22
SKETCH_BITS = 16


def _sketch_place(on: Sequence[str], rows: int) -> tuple[Column, Column]:
    """The sketch row of a key, and its two bits there; both from different bits of one hash."""
    number = F.xxhash64(*on)
    one = F.lit(1).cast("long")

    def bit(at: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(number, at).bitwiseAND(F.lit(63)).cast("int"))

    return F.pmod(number, F.lit(rows)).cast("int"), bit(26).bitwiseOR(bit(40))


def key_sketch(keys: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """``__place, __bits``: the bits of all keys, united; at most ``rows`` rows whatever the keys."""
    place, bits = _sketch_place(on, rows)
    return keys.select(place.alias("__place"), bits.alias("__bits")).groupBy("__place").agg(F.bit_or("__bits").alias("__bits"))


def sketch_rows(n_keys: int) -> int:
    """A power of two: ``SKETCH_BITS`` bits a key or more, up to ``SKETCH_ROWS`` rows."""
    wanted = max(1, n_keys * SKETCH_BITS // 64)
    return min(SKETCH_ROWS, 1 << max(6, wanted.bit_length()))


def with_known_keys(background: DataFrame, keys: DataFrame, on: Sequence[str], n_keys: int) -> DataFrame:
    """Background rows whose key may be among ``keys``: all that are, and few others. No row is shuffled."""
    rows = sketch_rows(n_keys)
    place, bits = _sketch_place(on, rows)
    sketch = key_sketch(keys, on, rows).withColumnRenamed("__bits", "__known")
    marked = background.withColumn("__place", place).withColumn("__bits", bits)
    hits = marked.join(F.broadcast(sketch), "__place").filter(F.col("__bits").bitwiseAND(F.col("__known")) == F.col("__bits"))
    return hits.select(*[column(c) for c in background.columns])


def _fetch(background: DataFrame, keys: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    n_keys = keys.count()
    if n_keys <= limit:
        return background.join(F.broadcast(keys), list(on))
    return with_known_keys(background, keys, on, n_keys).join(keys, list(on))


def match_node_features(
    background: DataFrame,
    nodes: DataFrame,
    features: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Background feature rows of the labelled nodes, with their component."""
    wide = background.select(F.col("clId").cast("long").alias("node_id"), *map(column, features))
    keys = nodes.select("node_id", "component_id")
    return _fetch(wide, keys, NODE_KEY, broadcast_rows).select(
        "component_id", "node_id", *map(column, features)
    )


def edge_source_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the component of their source node, NULL when it is unknown."""
    source = nodes.select(F.col("node_id").alias("source_node_id"), "component_id")
    return edges.join(source, "source_node_id", "left")


def match_edge_features(
    background: DataFrame,
    labelled_edges: DataFrame,
    features: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Background feature rows of the labelled edges, matched on all three key columns."""
    wide = background.select(
        F.col("clId1").cast("long").alias("source_node_id"),
        F.col("clId2").cast("long").alias("target_node_id"),
        F.col("txId").cast("long").alias("transaction_id"),
        *map(column, features),
    )
    keys = labelled_edges.select(*EDGE_KEY, "component_id")
    return _fetch(wide, keys, EDGE_KEY, broadcast_rows).select(
        "component_id", *EDGE_KEY, *map(column, features)
    )


def feature_statistics(features: Sequence[str], prefix: str) -> list[Column]:
    """Mean, population deviation, minimum and maximum of each feature, as ``prefix_NN_stat``."""
    return [
        fn(column(name)).alias(f"{prefix}_{i:02d}_{stat}")
        for i, name in enumerate(features, 1)
        for stat, fn in STATISTICS
    ]


def _hot_components(rows: DataFrame, limit: int) -> list[int]:
    """Components with more than ``limit`` rows: at most one id for so many rows reaches the driver."""
    counted = rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    return [r.component_id for r in counted.filter(F.col("n") > limit).collect()]


def _folded(rows: DataFrame, statistics: Sequence[Column], hot: Sequence[int]) -> DataFrame:
    """``statistics`` per component; only the rows of ``hot`` components are combined before they move.

    A combined row carries seven numbers for each feature, a plain one carries one. Components
    of few rows meet in a task about once, so combining them first would move seven times as much.
    """
    if not hot:
        return rows.repartition("component_id").groupBy("component_id").agg(*statistics)
    among = F.col("component_id").isin(*hot)
    rest = _folded(rows.filter(~among), statistics, ())
    return rest.unionByName(rows.filter(among).groupBy("component_id").agg(*statistics))


def _aggregate(
    matched: DataFrame, features: Sequence[str], prefix: str, count: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All statistics per component, at most ``FEATURES_PER_PASS`` features at a time.

    Each pass reads and moves its own columns of the matched table and leaves its result
    partitioned by component, so putting the passes together moves no row.
    """
    rows = matched.filter("component_id IS NOT NULL")
    statistics = feature_statistics(features, prefix)
    width = FEATURES_PER_PASS * len(STATISTICS)
    hot = _hot_components(rows, hot_rows)
    passes = []
    for start in range(0, max(len(statistics), 1), width):
        counter = [F.count(F.lit(1)).alias(count)] if start == 0 else []
        passes.append(_folded(rows, [*counter, *statistics[start : start + width]], hot))
    return reduce(lambda a, b: a.join(b, "component_id"), passes)


def aggregate_node_features(matched: DataFrame, features: Sequence[str]) -> DataFrame:
    """``matched_node_count`` and the feature statistics; pass a written matched table."""
    return _aggregate(matched, features, "node_feat", "matched_node_count")


def aggregate_edge_features(matched: DataFrame, features: Sequence[str]) -> DataFrame:
    """``matched_edge_count`` and the feature statistics; pass a written matched table."""
    return _aggregate(matched, features, "edge_feat", "matched_edge_count")


def attach_node_aggregates(store: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Components without a matched node keep NULL."""
    return store.join(aggregates, "component_id", "left")


def attach_edge_aggregates(store: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Components without a matched edge get 0 in the count and in every statistic."""
    added = [c for c in aggregates.columns if c != "component_id"]
    joined = store.join(aggregates, "component_id", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast(joined.schema[c].dataType)) for c in added}
    )


def _key_presence(labelled: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key on the labelled and on the matched side, in one shuffle."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = labelled.select(*keys, one.alias("labelled"), none.alias("matched")).unionByName(
        matched.select(*keys, none.alias("labelled"), one.alias("matched"))
    )
    return rows.groupBy(*keys).agg(
        F.sum("labelled").alias("labelled"), F.sum("matched").alias("matched")
    )


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def node_match_audit(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of match counts for labelled nodes; a NULL key is a row but no distinct key."""
    real = F.col("node_id").isNotNull()
    return (
        _key_presence(nodes, matched, NODE_KEY)
        .agg(
            _total("labelled").alias("labeled_node_rows"),
            F.count_if(real & (F.col("labelled") > 0)).alias("distinct_labeled_nodes"),
            _total("matched").alias("matched_background_rows"),
            F.count_if(real & (F.col("matched") > 0)).alias("distinct_matched_nodes"),
        )
        .withColumns(
            {
                "missing_labeled_nodes": F.col("distinct_labeled_nodes") - F.col("distinct_matched_nodes"),
                "duplicate_background_matches": F.col("matched_background_rows")
                - F.col("distinct_matched_nodes"),
            }
        )
    )


NODE_GATE = ("missing_labeled_nodes", "duplicate_background_matches")


def edge_match_audit(labelled_edges: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of match counts for labelled edges on their three-column key."""
    unmapped = labelled_edges.select(
        *EDGE_KEY, F.col("component_id").isNull().cast("long").alias("unmapped")
    )
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = unmapped.select(
        *EDGE_KEY, "unmapped", one.alias("labelled"), none.alias("matched")
    ).unionByName(
        matched.select(
            *EDGE_KEY, none.alias("unmapped"), none.alias("labelled"), one.alias("matched")
        )
    )
    return (
        rows.groupBy(*EDGE_KEY)
        .agg(*[F.sum(c).alias(c) for c in ("unmapped", "labelled", "matched")])
        .agg(
            _total("labelled").alias("labeled_edge_rows"),
            F.count_if(F.col("labelled") > 0).alias("distinct_labeled_edge_keys"),
            _total("unmapped").alias("missing_component_ids"),
            _total("matched").alias("matched_background_rows"),
            F.count_if(F.col("matched") > 0).alias("distinct_matched_edge_keys"),
        )
        .withColumns(
            {
                "duplicate_labeled_edge_keys": F.col("labeled_edge_rows")
                - F.col("distinct_labeled_edge_keys"),
                "missing_labeled_edges": F.col("distinct_labeled_edge_keys")
                - F.col("distinct_matched_edge_keys"),
                "duplicate_background_matches": F.col("matched_background_rows")
                - F.col("distinct_matched_edge_keys"),
            }
        )
    )


EDGE_GATE = (
    "duplicate_labeled_edge_keys",
    "missing_component_ids",
    "missing_labeled_edges",
    "duplicate_background_matches",
)


def enrichment_coverage(store: DataFrame, count_column: str, probe_column: str) -> DataFrame:
    """One row: store rows, positives, components without a match, rows with NULL statistics."""
    return store.agg(
        F.count(F.lit(1)).alias("output_component_rows"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("positive_component_rows"),
        F.count_if(F.coalesce(F.col(count_column), F.lit(0)) == 0).alias("components_without_features"),
        F.count_if(F.col(probe_column).isNull()).alias("rows_with_null_aggregates"),
    )
