"""Raw tables derived from the order tables of a test-data folder.

A component is a customer, a node is an order, and an edge links two successive line items
of one customer within one supplier bucket. Narrow tables, matches and stores are written
once per session and folder to the shared scratch folder, as the stages of a real run hand
over files; the wide background tables are computed as they are read, so a query moves only
the columns that it takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph.functions.labels import column, prefixed_features
from riskgraph.operators import enrich, structure
from riskgraph.session import materialize
from riskgraph.sources.raw import NODE_FEATURES, typed_components, typed_edges, typed_nodes

SAMPLE_EDGE_FEATURES = 95
VECTOR_SIZE = 64
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


class SampleTables:
    """Lazily staged raw tables and stores of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STAGED:
            _STAGED[key] = materialize(build(), name)
        return _STAGED[key]

    # Raw tables.

    def raw_components(self) -> DataFrame:
        label = (
            F.when(F.col("c_acctbal") < 0, " Suspicious")
            .when(F.col("c_custkey") % 50 == 7, "unknown")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "non-suspicious")
            .otherwise("Licit")
        )
        return self._read("customer").select(F.col("c_custkey").alias("ccId"), label.alias("ccLabel"))

    def raw_nodes(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("clId"), F.col("o_custkey").alias("ccId")
        )

    def _paired_items(self) -> DataFrame:
        """Line items with the next one of the same customer and supplier bucket."""
        orders = self._read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        items = self._read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
        successive = Window.partitionBy("o_custkey", F.col("l_suppkey") % 50).orderBy(
            "o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_quantity", "l_extendedprice",
        )
        return (
            items.join(orders, items.l_orderkey == orders.o_orderkey)
            .withColumn("clId2", F.lead("l_orderkey").over(successive))
            .filter("clId2 IS NOT NULL")
            .select(
                F.col("l_orderkey").alias("clId1"),
                "clId2",
                (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("txId"),
                F.col("l_quantity").alias("feat#1"),
                F.col("l_extendedprice").alias("feat#2"),
                F.col("l_discount").alias("feat#3"),
                F.col("l_tax").alias("feat#4"),
                F.col("l_linenumber").cast("double").alias("feat#5"),
            )
        )

    def paired_items(self) -> DataFrame:
        """The pairs with their own five features, written once: eight columns, whatever hangs on them later."""
        return self._staged("paired_items", self._paired_items)

    def _widened(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with all edge features: their own five, a vector's entries, and some of those by quantity.

        Not written: a reader of the keys alone must not pay for the features.
        """
        vectors = self._read("embeddings").select("vec_id", "embedding")
        size = vectors.count()
        numbered = pairs.withColumn("vec_id", F.col("txId") % size)
        entry = [F.element_at("embedding", i + 1).cast("double") for i in range(VECTOR_SIZE)]
        scaled = SAMPLE_EDGE_FEATURES - 5 - VECTOR_SIZE
        made = [*entry, *[e * F.col("`feat#1`") for e in entry[:scaled]]]
        joined = numbered.join(vectors, "vec_id")
        kept = [column(c) for c in pairs.columns]
        return joined.select(*kept, *[e.alias(f"feat#{i}") for i, e in enumerate(made, 6)])

    def raw_clean_edges(self) -> DataFrame:
        return self._widened(self.paired_items()).select("clId1", "clId2", "txId")

    def raw_edges(self) -> DataFrame:
        """Clean edges plus some that cross components and some with an unknown target."""
        order = F.col("o_orderkey")
        orders = self._read("orders")
        crossing = orders.filter(order % 97 == 0).select(
            order.alias("clId1"), (order + 1).alias("clId2"), (order + 9000000000000).alias("txId")
        )
        dangling = orders.filter(order % 101 == 0).select(
            order.alias("clId1"),
            (order + 1000000000).alias("clId2"),
            (order + 8000000000000).alias("txId"),
        )
        return self.raw_clean_edges().unionByName(crossing).unionByName(dangling)

    def background_nodes(self) -> DataFrame:
        """One feature row per order, and a copy under ids that never match."""
        vectors = self._read("embeddings")
        size = vectors.count()
        wide = vectors.select(
            "vec_id",
            *[
                F.element_at("embedding", i).cast("double").alias(f"feat#{i}")
                for i in range(1, NODE_FEATURES)
            ],
            F.lit(1.0).alias(f"feat#{NODE_FEATURES}"),
        )
        # Spread the narrow ids, not the wide rows: a small folder is one file, so one task.
        parts = self.spark.sparkContext.defaultParallelism
        orders = (
            self._read("orders")
            .select(F.col("o_orderkey").alias("clId"), (F.col("o_orderkey") % size).alias("vec_id"))
            .repartition(parts, "clId")
        )
        rows = orders.join(wide, "vec_id").drop("vec_id")
        return rows.unionByName(rows.withColumn("clId", F.col("clId") + 7000000000))

    def background_edges(self) -> DataFrame:
        """The wide pairs, and a copy of each under a source that never matches; the pairs are read once."""
        pairs = self.paired_items()
        sources = F.explode(F.array("clId1", F.col("clId1") + 7000000000)).alias("clId1")
        return self._widened(pairs.select(sources, *[column(c) for c in pairs.columns if c != "clId1"]))

    # Typed tables.

    def components(self) -> DataFrame:
        return typed_components(self.raw_components())

    def nodes(self) -> DataFrame:
        return typed_nodes(self.raw_nodes())

    def edges(self) -> DataFrame:
        return typed_edges(self.raw_edges())

    def clean_edges(self) -> DataFrame:
        return typed_edges(self.raw_clean_edges())

    # Scores.

    def scores(self) -> DataFrame:
        """Two scored models over the labelled components: many ties, and perfect separation."""
        return self._staged("scores", self._scores)

    def _scores(self) -> DataFrame:
        labelled = self.components().filter("label IS NOT NULL")
        orders = self._read("orders").select("o_orderkey", "o_custkey")
        items = self._read("lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
        share = (
            items.join(orders, items.l_orderkey == orders.o_orderkey)
            .groupBy(F.col("o_custkey").alias("component_id"))
            .agg((F.floor(100.0 * F.sum(returned) / F.sum("l_quantity")) / 100).alias("share"))
        )
        tied = labelled.join(share, "component_id", "left").select(
            "component_id",
            "label",
            F.coalesce("share", F.lit(0.0)).alias("risk_score"),
            F.lit("return_share").alias("model"),
        )
        balance = self._read("customer").select(
            F.col("c_custkey").alias("component_id"),
            ((10000 - F.col("c_acctbal")) / 11000).alias("risk_score"),
        )
        separating = labelled.join(balance, "component_id").select(
            "component_id", "label", "risk_score", F.lit("balance").alias("model")
        )
        return tied.unionByName(separating)

    # Matched background rows: written once, read by the audits and every aggregation pass.

    def matched_nodes(self) -> DataFrame:
        features = prefixed_features(self.background_nodes(), expected=NODE_FEATURES)
        return self._staged(
            "matched_nodes",
            lambda: enrich.match_node_features(self.background_nodes(), self.nodes(), features),
        )

    def matched_edges(self) -> DataFrame:
        features = prefixed_features(self.background_edges(), expected=SAMPLE_EDGE_FEATURES)
        keys = enrich.edge_source_component(self.clean_edges(), self.nodes())
        return self._staged(
            "matched_edges",
            lambda: enrich.match_edge_features(self.background_edges(), keys, features),
        )

    # Stores.

    def feature_store(self) -> DataFrame:
        return self._staged(
            "feature_store",
            lambda: structure.component_structural_features(
                self.components(), self.nodes(), self.edges()
            ),
        )

    def node_store(self) -> DataFrame:
        return self._staged("node_store", self._node_store)

    def _node_store(self) -> DataFrame:
        matched = self.matched_nodes()
        aggregates = enrich.aggregate_node_features(matched, prefixed_features(matched))
        return enrich.attach_node_aggregates(self.feature_store(), aggregates)

    def node_edge_store(self) -> DataFrame:
        return self._staged("node_edge_store", self._node_edge_store)

    def _node_edge_store(self) -> DataFrame:
        matched = self.matched_edges()
        aggregates = enrich.aggregate_edge_features(matched, prefixed_features(matched))
        return enrich.attach_edge_aggregates(self.node_store(), aggregates)
