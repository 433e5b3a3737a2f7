"""Validation, calibration and comparison as complete runs with gates first and resumable stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import numeric_features, require_columns
from riskgraph.operators import gates, linking, metrics, models, neighbors, profile, ranking, splits, tables
from riskgraph.plans.stages import Stages
from riskgraph.sources.stores import enforce

QUALITY = ("average_precision", "roc_auc", "brier_score")
BUDGET_VALUES = ("precision_at_budget", "recall_at_budget", "lift_at_budget", "suspicious_captured")
# Each keeps its training rows in memory while it fits its logistic baseline.
FITS_AT_ONCE = 4
STORE_GATE = ("duplicate_component_ids", "nonfinite_feature_values", "rows_without_class")


def store_audit(store: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """The leakage audit, and how many rows have a label other than 0 and 1."""
    audit = profile.leakage_audit(store, features)
    classed = F.col("positive_rows") + F.col("negative_rows")
    return audit.withColumn("rows_without_class", F.col("rows") - classed)


def require_fit_store(stages: Stages, store: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Write the audit of a store, then fail on repeated ids, non-finite cells or other labels."""
    require_columns(store, ("component_id", "label"))
    return enforce(stages.table("audit", lambda: store_audit(store, features)), STORE_GATE)


@dataclass
class ValidationRun:
    audit: DataFrame
    separation: DataFrame
    quality: DataFrame
    budgets: DataFrame
    summary: DataFrame
    budget_summary: DataFrame
    permutation: DataFrame
    importance: DataFrame
    reliability: DataFrame
    gate: DataFrame
    dominance: DataFrame
    manifest: DataFrame


Fit = Callable[[DataFrame, Sequence[str], int], Sequence[object]]


def validation_run(
    store: DataFrame,
    folder: str,
    seeds: Sequence[int] = models.VALIDATION_SEEDS,
    fraction: float = 0.20,
    permutation_seed: int = 42,
    trees: int = models.TREES,
    fit: Fit | None = None,
) -> ValidationRun:
    """Gates, repeated splits, summaries, shuffled labels, importance and verdict of one store.

    Every seed's scores and measures are stages in ``folder``, so a run that was stopped fits
    the remaining seeds only. Importance and reliability come from the split of
    ``permutation_seed``. ``fit`` (train, features, seed) gives fitted models and is called one
    seed after the other; the two baselines are the default, ``FITS_AT_ONCE`` side by side, as
    a fit leaves cores idle between its many short jobs.
    """
    names = numeric_features(store)
    side_by_side = fit is None
    fit = fit or (lambda train, features, seed: models.fit_baselines(train, features, seed, trees))
    settings = {"seeds": list(seeds), "fraction": fraction, "permutation_seed": permutation_seed, "trees": trees, "features": names}
    stages = Stages(store.sparkSession, folder, settings)
    audit = require_fit_store(stages, store, names)
    separation = stages.table("separation", lambda: gates.class_separation(store, names))

    def scores(seed: int) -> DataFrame:
        train, test = models.train_test(store, fraction, seed)
        scored = models.score_cases(fit(train, names, seed), test)
        return scored.withColumn("seed", F.lit(seed).cast("long"))

    def measured(seed: int, table: Callable) -> tuple[DataFrame, DataFrame]:
        scored = table(f"scores-{seed}", lambda: scores(seed))
        return (
            table(f"quality-{seed}", lambda: metrics.ranking_and_brier(scored, ("seed", "model"))),
            table(f"budgets-{seed}", lambda: metrics.review_budget_metrics(scored, group=("seed", "model"))),
        )

    def mixed() -> DataFrame:
        return splits.shuffle_labels(models.train_test(store, fraction, permutation_seed)[0], permutation_seed)

    def shuffled() -> DataFrame:
        _, test = models.train_test(store, fraction, permutation_seed)
        train = stages.build("shuffled-labels", mixed)
        return metrics.global_metrics(models.score_cases(fit(train, names, permutation_seed), test))

    fitted: list = []

    def chosen() -> Sequence[object]:
        if not fitted:
            train, _ = models.train_test(store, fraction, permutation_seed)
            fitted.extend(fit(train, names, permutation_seed))
        return fitted

    def important() -> DataFrame:
        return models.feature_importance(*chosen(), store)

    if side_by_side:
        work = [partial(measured, seed, stages.build) for seed in seeds]
        work += [partial(stages.build, "permutation", shuffled), partial(stages.build, "importance", important)]
        with ThreadPool(FITS_AT_ONCE) as pool:
            pool.map(inheritable_thread_target(store.sparkSession)(lambda build: build()), work, chunksize=1)

    parts = [measured(seed, stages.table) for seed in seeds]
    all_quality, all_budgets = (reduce(DataFrame.unionByName, column) for column in zip(*parts))
    summary = stages.table("summary", lambda: metrics.repeat_summary(all_quality, QUALITY))
    budget_summary = stages.table(
        "budget-summary", lambda: metrics.repeat_summary(all_budgets, BUDGET_VALUES, ("model", "review_fraction"))
    )
    stages.table("shuffled-labels", mixed)
    permutation = stages.table("permutation", shuffled)
    importance = stages.table("importance", important)
    reliability = stages.table(
        "reliability",
        lambda: metrics.reliability_table(models.score_cases(chosen(), models.train_test(store, fraction, permutation_seed)[1])),
    )
    gate = stages.table("gate", lambda: gates.validation_gate(summary, budget_summary, permutation, audit))
    dominance = stages.table("dominance", lambda: gates.dominance_review(importance))
    return ValidationRun(
        audit, separation, all_quality, all_budgets, summary, budget_summary, permutation, importance, reliability,
        gate, dominance, stages.manifest(),
    )


@dataclass
class CalibrationRun:
    scores: DataFrame
    parts: DataFrame
    metrics: DataFrame
    bins: DataFrame
    budgets: DataFrame
    best: DataFrame
    manifest: DataFrame


def calibration_run(store: DataFrame, folder: str, seed: int = 42, trees: int = models.TREES) -> CalibrationRun:
    """Raw, sigmoid and isotonic scores of the test part, measured per method, and the best method."""
    names = numeric_features(store)
    stages = Stages(store.sparkSession, folder, {"seed": seed, "trees": trees, "features": names})
    require_fit_store(stages, store, names)
    split = splits.three_way_split(store.select("component_id", "label"), seed=seed)
    parts = stages.table("parts", lambda: splits.split_audit(split, ("part",)))
    scores = stages.table("scores", lambda: models.calibration_scores(store, seed, names, trees))
    measured = stages.table("metrics", lambda: metrics.calibration_method_metrics(scores))
    return CalibrationRun(
        scores,
        parts,
        measured,
        stages.table("bins", lambda: metrics.calibration_bins(scores, "method")),
        stages.table("budgets", lambda: metrics.review_budget_metrics(scores, group="method")),
        stages.table("best", lambda: ranking.best_calibration_method(measured, models.RAW_FOREST)),
        stages.manifest(),
    )


@dataclass
class ComparisonRun:
    comparison: DataFrame
    budgets: DataFrame
    scores: DataFrame
    manifest: DataFrame


def comparison_run(
    graph: dict[str, DataFrame],
    store: DataFrame,
    features: Sequence[str],
    folder: str,
    layers: int = 2,
    fraction: float = 0.20,
    seed: int = 42,
    trees: int = models.TREES,
) -> ComparisonRun:
    """The graph classifier against the forest on the same components and the same test rows.

    Both universes must hold the same components with the same labels, and both runs the same
    test ids; otherwise nothing is measured.
    """
    stages = Stages(store.sparkSession, folder, {"layers": layers, "fraction": fraction, "seed": seed, "trees": trees, "features": list(features)})
    names = numeric_features(store)
    require_fit_store(stages, store, names)
    labelled = graph["components"].filter("label IS NOT NULL")
    universe = stages.table("universe", lambda: linking.universe_match(labelled, store.select("component_id", "label")))
    enforce(universe, universe.columns)

    def of_graph() -> DataFrame:
        return neighbors.graph_feature_classifier(graph, features, layers, fraction, seed)[1]

    def of_store() -> DataFrame:
        train, test = models.train_test(store, fraction, seed)
        return models.fit_random_forest(train, names, seed, trees).score(test)

    first, second = stages.table("graph-scores", of_graph), stages.table("forest-scores", of_store)
    audit = stages.table("test-audit", lambda: linking.matched_test_audit(first, second))
    enforce(audit, ("only_left", "only_right"))
    scores = first.unionByName(second)
    quality = stages.table("quality", lambda: metrics.global_metrics(scores))
    one, two = (f.select("model").first().model for f in (first, second))
    budgets = {}
    for name, scored in ((one, first), (two, second)):
        budgets[name] = stages.table(f"budgets-{name}", lambda: metrics.review_budget_metrics(scored))
    return ComparisonRun(
        stages.table("comparison", lambda: metrics.model_comparison(quality, one, two)),
        stages.table("budgets", lambda: tables.benchmark_budget_union(budgets)),
        scores,
        stages.manifest(),
    )
