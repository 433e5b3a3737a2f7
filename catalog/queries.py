"""One query per operator, over the tables of a test-data folder.

Doubles are rounded to six places at the very end, as two engines sum in different orders.
A fixed nudge before that keeps exact decimal ties (a sum of cents over 32 rows) from being
decided by the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskgraph.functions import labels, review
from riskgraph.operators import (
    calibration, enrich, evidence, gates, linking, metrics, models, neighbors, profile, ranking, splits,
    structure, tables,
)
from riskgraph.plans import review as runs
from riskgraph.plans import validation
from riskgraph.session import materialize, new_scratch_path
from riskgraph.sources import raw, stores
from riskgraph.sources.sample import SAMPLE_EDGE_FEATURES, SampleTables

PLACES = 6
NUDGE = 1.7e-8
SEEDS = models.VALIDATION_SEEDS
EVIDENCE_FEATURES = (
    *structure.STRUCTURAL_COLUMNS,
    "matched_node_count",
    *[f"node_feat_{i:02d}_{stat}" for i in range(1, raw.NODE_FEATURES + 1) for stat, _ in enrich.STATISTICS],
)
TOP_FEATURES = 15
BUCKETS = 8
GRAPH_FEATURES = tuple(f"node_feat_{i:02d}" for i in range(1, 44))

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
_FITS: dict[tuple[str, str, str], object] = {}


# Queries that only pass values on, so that nothing is summed, and scores of fits, whose small
# values and order rounding would spoil.
EXACT = (
    "match_node_features", "match_edge_features", "rename_feature_columns", "graph_dataset",
    "fit_logistic", "fit_random_forest", "score_cases", "feature_importance", "scan_raw_tables",
    "forest_calibration", "graph_feature_classifier", "structural_review_queue", "canonical_review_queue",
)


def query(build: Callable[[SampleTables], DataFrame]) -> Callable[[SampleTables], DataFrame]:
    """Register ``build`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = build(SampleTables(spark, folder))
        return df if build.__name__ in EXACT else rounded(df)

    REGISTRY[build.__name__] = run
    return build


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(labels.column(f.name) + NUDGE, PLACES).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else labels.column(f.name)
            for f in df.schema.fields
        ]
    )


def once(t: SampleTables, name: str, build: Callable[[], object]):
    """Fit a model or write a shared table only once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _FITS:
        _FITS[key] = build()
    return _FITS[key]


# Shared inputs.


def valid(t: SampleTables) -> DataFrame:
    return once(t, "valid_edges", lambda: linking.written_valid_edges(t.edges(), t.nodes()))


def pairs(t: SampleTables) -> DataFrame:
    return structure.pair_multiplicity(structure.edge_multiplicity(valid(t)))


def canonical(t: SampleTables) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes and edges: clean edges with the component of their source."""
    edges = linking.clean_graph_edges(t.clean_edges(), t.nodes()).select(
        "component_id",
        F.col("source_node_id").alias("source"),
        F.col("target_node_id").alias("target"),
    )
    return t.nodes(), edges


def fit_store(t: SampleTables) -> DataFrame:
    """The node-enriched store that fits take; a component without a matched node has 0 in every statistic."""
    return once(t, "fit_store", lambda: materialize(t.node_store().fillna(0), "fit_store"))


def evidence_store(t: SampleTables) -> DataFrame:
    """The node-enriched store with doubles at nine places, so that equal values are equal in any engine.

    Not written: rounding goes through decimals, and evidence reads few of the columns.
    """
    store = t.node_store()
    return store.select(
        *[
            F.round(labels.column(f.name), 9).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else labels.column(f.name)
            for f in store.schema.fields
        ]
    )


def top_store(t: SampleTables) -> DataFrame:
    """The columns of the evidence store that evidence is drawn from, rounded once and written."""
    return once(
        t,
        "top_store",
        lambda: materialize(
            evidence_store(t).select("component_id", "label", *map(labels.column, weights(t))), "top_store"
        ),
    )


def given_importance(t: SampleTables) -> DataFrame:
    """A given importance table: share of each feature in the class separation.

    It stands in for a fitted forest's table, which has no SQL, under the column name that
    the operators read; ``feature_importance`` gives the forest's own.
    """

    def build() -> DataFrame:
        apart = gates.class_separation(t.node_store(), EVIDENCE_FEATURES)
        size = F.col("abs_standardized_mean_difference")
        # One row per listed feature.
        share = size / F.sum(size).over(Window.partitionBy())
        return materialize(
            apart.select("feature", F.round(share, PLACES).alias("random_forest_importance")),
            "importance",
        )

    return once(t, "importance", build)


def weights(t: SampleTables) -> dict[str, float]:
    return once(
        t,
        "weights",
        lambda: evidence.candidate_features(given_importance(t), evidence_store(t), TOP_FEATURES),
    )


def queue(t: SampleTables) -> DataFrame:
    return once(
        t,
        "queue",
        lambda: materialize(
            ranking.review_queue(t.scores().drop("label"), "return_share"), "queue"
        ),
    )


def cases(t: SampleTables) -> DataFrame:
    return once(
        t,
        "cases",
        # Written before the check, which would compute all evidence a second time.
        lambda: evidence.require_evidence(
            materialize(evidence.case_evidence_topk(queue(t), top_store(t), weights(t)), "cases")
        ),
    )


def long_evidence(t: SampleTables) -> DataFrame:
    return evidence.evidence_long(cases(t))


def seed_scores(t: SampleTables) -> DataFrame:
    """Given scores on the test rows of every validation seed."""

    def build() -> DataFrame:
        parts = splits.repeated_parts(t.feature_store(), SEEDS).filter("part = 'test'")
        return materialize(parts.select("seed", "component_id").join(t.scores(), "component_id"), "seeds")

    return once(t, "seed_scores", build)


def seed_metrics(t: SampleTables) -> DataFrame:
    return once(
        t,
        "seed_metrics",
        lambda: materialize(metrics.ranking_and_brier(seed_scores(t), ("seed", "model")), "quality"),
    )


def seed_budgets(t: SampleTables) -> DataFrame:
    return once(
        t,
        "seed_budgets",
        lambda: materialize(
            metrics.review_budget_metrics(seed_scores(t), group=("seed", "model")), "budgets"
        ),
    )


QUALITY = ("average_precision", "roc_auc", "brier_score")
BUDGET_VALUES = ("precision_at_budget", "recall_at_budget", "lift_at_budget", "suspicious_captured")


def budget_summary(t: SampleTables) -> DataFrame:
    return metrics.repeat_summary(seed_budgets(t), BUDGET_VALUES, ("model", "review_fraction"))


def given_budgets(t: SampleTables) -> DataFrame:
    return once(
        t,
        "given_budgets",
        lambda: materialize(metrics.review_budget_metrics(t.scores()), "budgets"),
    )


def method_metrics(t: SampleTables) -> DataFrame:
    return once(
        t,
        "method_metrics",
        lambda: materialize(
            metrics.calibration_method_metrics(t.scores().withColumnRenamed("model", "method")),
            "methods",
        ),
    )


def graph(t: SampleTables) -> dict[str, DataFrame]:
    def build() -> dict[str, DataFrame]:
        parts = neighbors.graph_dataset(
            t.components(), t.nodes(), t.clean_edges(), t.background_nodes(), raw.NODE_FEATURES
        )
        return {name: materialize(df, f"graph_{name}") for name, df in parts.items()}

    return once(t, "graph", build)


def labelled_graph(t: SampleTables) -> dict[str, DataFrame]:
    parts = graph(t)
    return {**parts, "components": parts["components"].filter("label IS NOT NULL")}


def matched_nodes(t: SampleTables) -> DataFrame:
    features = labels.prefixed_features(t.background_nodes(), expected=raw.NODE_FEATURES)
    return enrich.match_node_features(t.background_nodes(), t.nodes(), features)


def matched_edges(t: SampleTables) -> DataFrame:
    features = labels.prefixed_features(t.background_edges(), expected=SAMPLE_EDGE_FEATURES)
    keys = enrich.edge_source_component(t.clean_edges(), t.nodes())
    return enrich.match_edge_features(t.background_edges(), keys, features)


# Sources, sinks, schema.


@query
def scan_raw_tables(t):
    """The five tables, written as CSV and read by the raw reader: keys, text, and the sum of the features."""
    folder = new_scratch_path(t.spark, "raw")
    given = {
        "connected_components": t.raw_components(),
        "nodes": t.raw_nodes(),
        "edges": t.raw_edges(),
        "background_nodes": t.background_nodes(),
        "background_edges": t.background_edges(),
    }
    for name, df in given.items():
        raw.write_raw_csv(df, f"{folder}/{name}.csv")

    def values(name: str, df: DataFrame) -> DataFrame:
        features = [c for c in df.columns if c.startswith("feat#")]
        ids = [c for c in df.columns if c not in (*features, "ccLabel")]
        id_of = [F.col(ids[i]) if i < len(ids) else F.lit(None).cast("long") for i in range(3)]
        total = reduce(lambda a, b: a + b, map(labels.column, features)) if features else F.lit(None).cast("double")
        text = F.col("ccLabel") if "ccLabel" in df.columns else F.lit(None).cast("string")
        return df.select(
            F.lit(name).alias("name"), *[c.alias(f"id_{i}") for i, c in enumerate(id_of, 1)],
            text.alias("label_text"), total.alias("feature_sum"),
        )

    read = raw.scan_raw_tables(t.spark, folder)
    return reduce(DataFrame.unionByName, [values(name, df) for name, df in read.items()])


@query
def scan_feature_store(t):
    path = stores.write_store(t.feature_store(), new_scratch_path(t.spark, "scan"))
    return stores.read_store(t.spark, path, ["component_id", "label", "node_count", "directed_density"])


@query
def write_store(t):
    path = stores.write_store(t.feature_store(), new_scratch_path(t.spark, "store"))
    return stores.read_store(t.spark, path)


@query
def write_result_csv(t):
    df = t.scores()
    path = stores.write_result_csv(df, new_scratch_path(t.spark, "scores") + ".csv")
    return stores.read_store(t.spark, path, schema=df.schema)


@query
def write_profile_json(t):
    audit = enrich.node_match_audit(t.nodes(), t.matched_nodes())
    return stores.enforce(audit, enrich.NODE_GATE, new_scratch_path(t.spark, "audit"))


@query
def schema_manifest(t):
    return raw.schema_manifest(
        {
            "connected_components": t.raw_components(),
            "nodes": t.raw_nodes(),
            "edges": t.raw_edges(),
            "background_nodes": t.background_nodes(),
            "background_edges": t.background_edges(),
        }
    )


@query
def discover_prefixed_features(t):
    df = t.background_nodes()
    return profile.column_coverage(df, labels.prefixed_features(df, expected=raw.NODE_FEATURES))


# Projections, filters, scalar functions.


@query
def cast_ids(t):
    return raw.typed_edges(t.raw_edges())


@query
def normalize_label(t):
    return t.raw_components().select(
        F.col("ccId").alias("component_id"),
        F.col("ccLabel").alias("raw_label"),
        labels.normalize_label(F.col("ccLabel")).alias("label"),
    )


@query
def labelled_only(t):
    return t.components().filter("label IS NOT NULL")


@query
def valid_edges(t):
    return valid(t).select("component_id", "source_node_id", "target_node_id", "transaction_id")


@query
def rename_feature_columns(t):
    df = t.background_nodes()
    return df.select("clId", *labels.renamed_features(labels.prefixed_features(df), "node_feat"))


@query
def zero_fill(t):
    joined = t.components().join(structure.component_edge_stats(valid(t)), "component_id", "left")
    return structure.zero_fill(joined, ("edge_count", "transaction_count", "self_loop_count"))


@query
def safe_ratios(t):
    return structure.safe_ratios(
        t.feature_store().drop("edges_per_node", "directed_density")
    ).select("component_id", "edges_per_node", "directed_density")


@query
def derived_signals(t):
    return structure.derived_signals(structure.simple_structural_features(*canonical(t))).select(
        "component_id", "flow_dispersion", "path_complexity"
    )


@query
def select_numeric_features(t):
    store = t.feature_store()
    return profile.column_coverage(store, labels.numeric_features(store))


@query
def nonfinite_count(t):
    store = t.node_store()
    return profile.nonfinite_count(store, labels.numeric_features(store))


@query
def target_name_columns(t):
    leaky = t.feature_store().withColumns(
        {"is_Suspicious": F.col("label"), "sub_class": F.nullif(F.col("label"), F.lit(0))}
    )
    return profile.target_name_columns(leaky, labels.numeric_features(leaky))


@query
def reason_codes(t):
    return queue(t).select("component_id", "reason_1", "reason_2", "score_type")


@query
def humanize_labels(t):
    counted = t.scores().groupBy("model").agg(F.count(F.lit(1)).alias("cases"))
    return tables.humanize_labels(counted, "model", {"balance": "Account balance"})


@query
def evidence_text(t):
    rows = evidence.feature_evidence(top_store(t), weights(t))
    text = review.evidence_text(
        F.col("feature"), F.col("value"), F.col("percentile"), F.col("zscore"), F.col("importance")
    )
    return rows.select("component_id", "feature", text.alias("evidence"))


@query
def drop_null_importance(t):
    known = given_importance(t)
    broken = known.unionByName(known.withColumn("random_forest_importance", F.lit(None).cast("double")))
    found = evidence.candidate_features(
        broken, t.node_store().drop("edge_count"), len(EVIDENCE_FEATURES)
    )
    return known.filter(F.col("feature").isin(*found))


@query
def drop_helper_columns(t):
    marked = queue(t).select(
        "component_id", "rank", F.col("risk_score").alias("__z__score"), F.lit(1).alias("__pct__x")
    )
    return evidence.drop_helper_columns(marked, ("__value__", "__pct__", "__z__"))


# Joins and referential integrity.


@query
def edge_component_map(t):
    return linking.edge_component_map(t.edges(), t.nodes())


@query
def node_degree(t):
    return structure.node_degree(t.nodes(), pairs(t))


@query
def assemble_component_store(t):
    multiplicity = structure.edge_multiplicity(valid(t))
    pair_rows = structure.pair_multiplicity(multiplicity)
    return structure.assemble_component_store(
        t.components(),
        structure.component_degree_stats(structure.node_degree(t.nodes(), pair_rows)),
        structure.transaction_stats(multiplicity),
        structure.unique_directed_pairs(pair_rows),
    )


@query
def bucketed_component_store(t):
    """The store from tables in buckets of the component, which join without a shuffle."""
    multiplicity = structure.edge_multiplicity(valid(t))
    pair_rows = structure.pair_multiplicity(multiplicity)
    parts = {
        "components": t.components(),
        "nodes": structure.component_degree_stats(structure.node_degree(t.nodes(), pair_rows)),
        "edges": structure.transaction_stats(multiplicity),
        "pairs": structure.unique_directed_pairs(pair_rows),
    }
    written = []
    for name, df in parts.items():
        path = new_scratch_path(t.spark, f"bucketed_{name}")
        written.append(stores.write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), path, "component_id", BUCKETS))
    return structure.assemble_component_store(*written)


@query
def match_node_features(t):
    return matched_nodes(t)


@query
def match_edge_features(t):
    return matched_edges(t)


@query
def edge_source_component(t):
    return enrich.edge_source_component(t.edges(), t.nodes())


@query
def attach_node_aggregates(t):
    features = labels.prefixed_features(t.background_nodes())
    return enrich.attach_node_aggregates(
        t.feature_store().select("component_id", "label"),
        enrich.aggregate_node_features(t.matched_nodes(), features),
    )


@query
def attach_edge_aggregates(t):
    features = labels.prefixed_features(t.background_edges())
    return enrich.attach_edge_aggregates(
        t.feature_store().select("component_id", "label"),
        enrich.aggregate_edge_features(t.matched_edges(), features),
    )


@query
def missing_endpoints(t):
    return linking.missing_endpoints(t.edges(), t.nodes())


@query
def cross_component_edges(t):
    return linking.cross_component_edges(t.edges(), t.nodes())


@query
def clean_graph_edges(t):
    return linking.clean_graph_edges(t.edges(), t.nodes())


@query
def join_labels(t):
    features = structure.simple_structural_features(*canonical(t))
    return structure.join_labels(features, t.components().filter("label IS NOT NULL"))


@query
def join_stats_many_to_one(t):
    stats = t.feature_store().select("component_id", "node_count", "directed_density")
    return linking.join_stats_many_to_one(queue(t).select("component_id", "rank"), stats)


@query
def component_node_counts(t):
    return profile.component_node_counts(t.raw_components(), t.raw_nodes())


@query
def count_outer_align(t):
    return structure.count_outer_align(*canonical(t))


@query
def universe_match(t):
    return linking.universe_match(t.components(), t.feature_store().select("component_id", "label"))


@query
def matched_test_audit(t):
    store = t.feature_store().select("component_id", "label")
    first = splits.stratified_split(store, seed=42).filter("is_test")
    second = splits.stratified_split(store, seed=11).filter("is_test")
    return linking.matched_test_audit(first, second)


@query
def unknown_reference_check(t):
    return linking.unknown_references(
        t.components().filter("label IS NOT NULL"), t.nodes(), t.edges()
    )


# Aggregations, profiling, quality.


@query
def component_structural_features(t):
    return structure.component_structural_features(t.components(), t.nodes(), t.edges())


@query
def in_out_degree(t):
    return structure.in_out_degree(pairs(t))


@query
def component_degree_stats(t):
    return structure.component_degree_stats(structure.node_degree(t.nodes(), pairs(t)))


@query
def unique_directed_pairs(t):
    return structure.unique_directed_pairs(pairs(t)).select("component_id", "unique_directed_pairs")


@query
def component_edge_stats(t):
    return structure.component_edge_stats(valid(t))


@query
def simple_structural_features(t):
    return structure.simple_structural_features(*canonical(t))


@query
def aggregate_node_features(t):
    features = labels.prefixed_features(t.background_nodes())
    return enrich.aggregate_node_features(t.matched_nodes(), features)


@query
def aggregate_edge_features(t):
    features = labels.prefixed_features(t.background_edges())
    return enrich.aggregate_edge_features(t.matched_edges(), features)


@query
def node_match_audit(t):
    return enrich.node_match_audit(t.nodes(), t.matched_nodes())


@query
def edge_match_audit(t):
    # The audit counts keys, so the matched rows are not written for it: their features are never computed.
    return enrich.edge_match_audit(
        enrich.edge_source_component(t.clean_edges(), t.nodes()), matched_edges(t)
    )


@query
def enrichment_coverage(t):
    node = enrich.enrichment_coverage(t.node_store(), "matched_node_count", "node_feat_01_mean")
    edge = enrich.enrichment_coverage(t.node_edge_store(), "matched_edge_count", "edge_feat_01_mean")
    return tables.union_model_results({"node": node, "edge": edge}, "stage")


@query
def label_counts(t):
    return profile.label_counts(t.raw_components())


@query
def node_count_by_label(t):
    return profile.node_count_by_label(t.raw_components(), t.raw_nodes())


@query
def edge_mapping_quality(t):
    return profile.edge_mapping_quality(t.edges(), t.nodes())


@query
def store_label_counts(t):
    return profile.store_label_counts(t.feature_store())


@query
def store_summary_by_label(t):
    return profile.store_summary_by_label(t.feature_store())


@query
def null_counts(t):
    return profile.null_counts(t.node_store())


@query
def filtered_counts(t):
    return profile.filtered_counts(t.components())


@query
def store_qa(t):
    return profile.store_qa(t.feature_store())


@query
def queue_qa(t):
    return profile.queue_qa(queue(t))


@query
def class_separation(t):
    return gates.class_separation(t.node_store())


@query
def leakage_audit(t):
    return profile.leakage_audit(t.node_store())


@query
def repeat_summary(t):
    return metrics.repeat_summary(seed_metrics(t), QUALITY)


@query
def repeat_budget_summary(t):
    return budget_summary(t)


@query
def graph_dataset_profile(t):
    parts = neighbors.graph_dataset(
        t.components(), t.nodes(), t.edges(), t.background_nodes(), raw.NODE_FEATURES
    )
    return neighbors.graph_dataset_profile(t.components(), t.nodes(), t.edges(), parts)


# Ranking and evidence.


@query
def review_queue(t):
    return ranking.review_queue(t.scores().drop("label"), "return_share")


@query
def priority_band(t):
    return queue(t).select("component_id", "rank", "review_fraction_rank", "priority_band")


@query
def average_rank_percentile(t):
    return evidence.average_rank_percentile(top_store(t), list(weights(t)))


@query
def feature_zscores(t):
    return evidence.feature_zscores(t.node_store(), labels.numeric_features(t.node_store()))


@query
def case_evidence_topk(t):
    found = evidence.case_evidence_topk(queue(t), top_store(t), weights(t))
    return found.select("component_id", F.posexplode("evidence").alias("at", "e")).select(
        "component_id",
        (F.col("at") + 1).alias("evidence_rank"),
        F.col("e.feature").alias("feature"),
        F.col("e.evidence_score").alias("evidence_score"),
    )


@query
def evidence_wide(t):
    return evidence.evidence_wide(cases(t)).drop("reason_1", "reason_2")


@query
def evidence_long(t):
    return long_evidence(t)


@query
def top_importance(t):
    return ranking.top_importance(given_importance(t), TOP_FEATURES)


@query
def top_separation(t):
    return ranking.top_separation(gates.class_separation(t.node_store()))


@query
def select_model(t):
    quality = metrics.global_metrics(t.scores())
    chosen = ranking.select_model(t.scores(), metrics=quality)
    return quality.filter(F.col("model") == chosen).select("model", "average_precision")


@query
def top_cases(t):
    return ranking.top_cases(long_evidence(t), 20)


@query
def best_calibration_method(t):
    return ranking.best_calibration_method(method_metrics(t), "return_share")


# Set operations.


@query
def union_model_results(t):
    per_model = {
        m: metrics.brier_score(t.scores().filter(F.col("model") == m)).drop("model")
        for m in ("return_share", "balance")
    }
    return tables.union_model_results(per_model)


@query
def benchmark_budget_union(t):
    budgets = given_budgets(t)
    return tables.benchmark_budget_union(
        {m: budgets.filter(F.col("model") == m) for m in ("return_share", "balance")}
    )


@query
def distinct_pairs(t):
    return valid(t).select("component_id", "source_node_id", "target_node_id").distinct()


# Chart tables.


@query
def metrics_long(t):
    return tables.metrics_long(method_metrics(t), ("brier_score", "log_loss", "ece", "roc_auc"))


@query
def case_feature_pivot(t):
    return tables.case_feature_pivot(long_evidence(t), 20, features=EVIDENCE_FEATURES)


def _pivot_cells(t, value: str) -> DataFrame:
    """The pivot whose columns come from the data, as its cells: place and name of the column, case, value."""
    wide = tables.case_feature_pivot(long_evidence(t), 20, value)
    names = wide.columns[2:]
    long = wide.unpivot(["rank", "component_id"], [labels.column(c) for c in names], "feature", "value")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("feature"))
    return long.select("rank", "component_id", place.alias("place"), "feature", "value")


@query
def case_pivot_by_score(t):
    return _pivot_cells(t, "zscore")


@query
def case_percentile_by_score(t):
    return _pivot_cells(t, "percentile")


@query
def evidence_frequency(t):
    return tables.evidence_frequency(long_evidence(t), 12)


@query
def band_counts(t):
    return tables.band_counts(queue(t))


@query
def evidence_strength_by_rank(t):
    return tables.evidence_strength_by_rank(long_evidence(t))


def _stage_metrics(t):
    """Given scores measured on the whole universe and on two test sets, as three stages."""
    whole = metrics.global_metrics(t.scores())
    seeds = seed_metrics(t)
    return [whole, seeds.filter("seed = 11"), seeds.filter("seed = 42")]


@query
def feature_stage_table(t):
    return tables.feature_stage_table(_stage_metrics(t), ("return_share", "balance"))


def _two_summaries(t):
    early = seed_metrics(t).filter("seed < 50")
    return [metrics.repeat_summary(early, QUALITY), metrics.repeat_summary(seed_metrics(t), QUALITY)]


@query
def feature_set_comparison(t):
    return tables.feature_set_comparison(_two_summaries(t), "return_share")


@query
def feature_set_budgets(t):
    early = metrics.repeat_summary(
        seed_budgets(t).filter("seed < 50"), BUDGET_VALUES, ("model", "review_fraction")
    )
    return tables.feature_set_budgets([early, budget_summary(t)], "return_share")


@query
def budget_curve_table(t):
    return tables.budget_curve_table(given_budgets(t))


# Evaluation metrics.


@query
def review_budget_metrics(t):
    return metrics.review_budget_metrics(t.scores())


@query
def average_precision(t):
    return metrics.average_precision(t.scores())


@query
def roc_auc(t):
    return metrics.roc_auc(t.scores())


@query
def global_metrics(t):
    return metrics.global_metrics(t.scores())


@query
def brier_score(t):
    return metrics.brier_score(t.scores())


@query
def log_loss(t):
    return metrics.log_loss(t.scores())


@query
def calibration_bins(t):
    return metrics.calibration_bins(t.scores())


@query
def reliability_table(t):
    return metrics.reliability_table(t.scores())


@query
def expected_calibration_error(t):
    return metrics.expected_calibration_error(t.scores())


@query
def calibration_method_metrics(t):
    return metrics.calibration_method_metrics(t.scores().withColumnRenamed("model", "method"))


@query
def model_comparison(t):
    return metrics.model_comparison(metrics.global_metrics(t.scores()), "return_share", "balance")


# Splits, models, calibration, gates.


@query
def stratified_split(t):
    return splits.stratified_split(t.feature_store()).select("component_id", "label", "is_test")


@query
def three_way_split(t):
    return splits.three_way_split(t.feature_store()).select("component_id", "label", "part")


@query
def repeated_split_parts(t):
    return splits.repeated_parts(t.feature_store(), SEEDS)


@query
def standardize_features(t):
    store = t.feature_store()
    names = labels.numeric_features(store)
    train, _ = models.train_test(store)
    return models.standardize_features(store, names, models.training_moments(train, names))


@query
def balanced_class_weights(t):
    return models.balanced_class_weights(t.feature_store())


@query
def shuffle_labels(t):
    return splits.shuffle_labels(t.feature_store().select("component_id", "label"))


@query
def split_audit(t):
    return splits.split_audit(splits.repeated_parts(t.feature_store(), SEEDS))


@query
def validation_gate(t):
    shuffled = splits.shuffle_labels(t.feature_store().select("component_id", "label"))
    blind = t.scores().drop("label").join(shuffled, "component_id")
    return gates.validation_gate(
        metrics.repeat_summary(seed_metrics(t), QUALITY),
        budget_summary(t),
        metrics.global_metrics(blind),
        profile.leakage_audit(fit_store(t)),
        model="balance",
    )


@query
def dominance_review(t):
    return gates.dominance_review(given_importance(t))


def _split(t):
    return once(t, "split", lambda: models.train_test(t.feature_store()))


def _logistic(t):
    return once(t, "logistic", lambda: models.fit_logistic(_split(t)[0]))


def _forest(t):
    return once(t, "forest", lambda: models.fit_random_forest(_split(t)[0]))


@query
def fit_logistic(t):
    return _logistic(t).score(_split(t)[1])


@query
def logistic_residuals(t):
    """Whether the fitted model stands at the optimum of its penalised loss, per coefficient."""
    found = models.logistic_residuals(_logistic(t), _split(t)[0])
    return found.select("feature", (F.abs("residual") < 0.001).alias("at_optimum"))


@query
def score_checks(t):
    """Every test row once per model, with a score between 0 and 1."""
    scored = models.score_cases([_logistic(t), _forest(t)], _split(t)[1])
    score = F.col("risk_score")
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("cases"),
        F.countDistinct("component_id").alias("components"),
        F.sum("label").alias("positives"),
        F.count_if(~score.between(0.0, 1.0) | F.isnan(score) | score.isNull()).alias("outside"),
    )


@query
def fit_random_forest(t):
    return _forest(t).score(_split(t)[1])


@query
def score_cases(t):
    return models.score_cases([_logistic(t), _forest(t)], _split(t)[1])


def _validation(t):
    return once(t, "validation", lambda: validation.validation_run(fit_store(t), new_scratch_path(t.spark, "validation")))


def _comparison(t):
    return once(
        t,
        "comparison",
        lambda: validation.comparison_run(
            labelled_graph(t), fit_store(t), GRAPH_FEATURES, new_scratch_path(t.spark, "comparison")
        ),
    )


def _calibration(t):
    return once(t, "calibration", lambda: validation.calibration_run(fit_store(t), new_scratch_path(t.spark, "calibration")))


@query
def feature_importance(t):
    return _validation(t).importance


@query
def repeated_splits(t):
    return _validation(t).quality


@query
def permutation_sanity(t):
    return _validation(t).permutation


@query
def validation_run(t):
    """Verdict on the fitted models of the node-enriched store."""
    return _validation(t).gate


@query
def calibration_run(t):
    """Quality of the forest's raw, sigmoid and isotonic scores."""
    return _calibration(t).metrics


@query
def comparison_run(t):
    """The graph classifier beside the forest on the same test rows."""
    return _comparison(t).comparison


def _held_out(t):
    """Calibration and test part of the given scores."""

    def build():
        parts = splits.three_way_split(t.feature_store().select("component_id", "label"))
        given = t.scores().filter("model = 'return_share'").select("component_id", "risk_score")
        return materialize(parts.join(given, "component_id"), "held_out")

    held = once(t, "held_out", build)
    return held.filter("part = 'calibration'"), held.filter("part = 'test'")


@query
def sigmoid_calibration(t):
    """Sigmoid fit of the given scores on the calibration part, applied to the test part."""
    return calibration.sigmoid_calibration(*_held_out(t)).select("component_id", "label", "risk_score")


@query
def isotonic_calibration(t):
    """Isotonic fit of the given scores on the calibration part, applied to the test part."""
    return calibration.isotonic_calibration(*_held_out(t)).select("component_id", "label", "risk_score")


@query
def forest_calibration(t):
    return _calibration(t).scores.select("method", "component_id", "label", "risk_score")


# Graph.


@query
def graph_dataset(t):
    """The nodes with all features; edges and components are queries of their own."""
    return graph(t)["nodes"].select(
        "node_id", "component_id", *[labels.column(f) for f in GRAPH_FEATURES]
    )


@query
def graph_dataset_edges(t):
    return graph(t)["edges"].select("component_id", "source_node_id", "target_node_id")


@query
def graph_dataset_components(t):
    return graph(t)["components"].select("component_id", "label")


@query
def forward_neighbor_mean(t):
    g = graph(t)
    return neighbors.neighbor_mean(g["nodes"], g["edges"], GRAPH_FEATURES)


@query
def reverse_neighbor_mean(t):
    g = graph(t)
    return neighbors.neighbor_mean(g["nodes"], g["edges"], GRAPH_FEATURES, True, "out_")


@query
def khop_dual_channel(t):
    g = graph(t)
    return neighbors.khop_dual_channel(g["nodes"], g["edges"], GRAPH_FEATURES, 2)


@query
def graph_mean_max_pool(t):
    return neighbors.graph_mean_max_pool(graph(t)["nodes"], GRAPH_FEATURES)


@query
def graph_feature_classifier(t):
    return _comparison(t).scores.filter("model = 'neighbor_aggregation'")


# Complete runs.


def _structural_run(t):
    return once(t, "structural_run", lambda: runs.structural_review(t.components(), t.nodes(), t.edges()))


def _canonical_run(t):
    nodes, edges = canonical(t)
    kept = t.components().filter("label IS NOT NULL")
    return once(t, "canonical_run", lambda: runs.canonical_review(kept, nodes, edges))


def _queue_checks(run) -> DataFrame:
    """One row: cases, ranks, cases that score higher than the one before, cases per first and last tier."""
    queued = materialize(run.queue, "queue")
    behind = queued.select((F.col("rank") - 1).alias("rank"), F.col("risk_score").alias("next_score"))
    pairs_ = queued.join(behind, "rank", "left")
    first, last = review.TIERS[0][0], review.STANDARD_TIER[0]
    return pairs_.agg(
        F.count(F.lit(1)).alias("cases"),
        F.countDistinct("component_id").alias("components"),
        F.min("rank").cast("long").alias("first_rank"),
        F.max("rank").cast("long").alias("last_rank"),
        F.count_if(F.col("next_score") > F.col("risk_score")).alias("out_of_order"),
        F.count_if(F.col("priority_band") == first).alias("first_tier"),
        F.count_if(F.col("priority_band") == last).alias("standard_tier"),
    )


@query
def structural_review_queue(t):
    return _structural_run(t).queue


@query
def canonical_review_queue(t):
    return _canonical_run(t).queue


@query
def structural_queue_checks(t):
    return _queue_checks(_structural_run(t))


@query
def canonical_queue_checks(t):
    return _queue_checks(_canonical_run(t))


@query
def explained_review_queue(t):
    found = runs.explained_cases(
        t.scores().drop("label"), evidence_store(t), given_importance(t), "return_share", top_n=TOP_FEATURES
    )
    return evidence.evidence_wide(found)
