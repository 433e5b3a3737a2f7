"""Complete runs: structural queue, canonical-table queue, explained queue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgraph.operators import evidence, metrics, models, ranking, structure
from riskgraph.session import materialize


@dataclass
class ReviewRun:
    """Results of one run; every table is written, so nothing is fitted twice."""

    metrics: DataFrame
    budgets: DataFrame
    scores: DataFrame
    model: str
    queue: DataFrame


def run_baselines(
    store: DataFrame,
    fraction: float = 0.20,
    seed: int = 42,
    budgets: Sequence[float] = metrics.BUDGETS,
    trees: int = models.TREES,
) -> ReviewRun:
    """Split, fit both baselines, measure them on the test rows and queue the better one."""
    train, test = models.train_test(store, fraction, seed)
    fitted = models.fit_baselines(train, seed=seed, trees=trees)
    scored = materialize(models.score_cases(fitted, test), "scored")
    quality = materialize(metrics.global_metrics(scored), "quality")
    chosen = ranking.select_model(scored, metrics=quality)
    return ReviewRun(
        metrics=quality,
        budgets=metrics.review_budget_metrics(scored, budgets),
        scores=scored,
        model=chosen,
        queue=ranking.review_queue(scored.drop("label"), chosen),
    )


def structural_review(
    components: DataFrame, nodes: DataFrame, edges: DataFrame, trees: int = models.TREES
) -> ReviewRun:
    """Typed tables to structural store to review queue."""
    store = materialize(structure.component_structural_features(components, nodes, edges), "store")
    return run_baselines(store, trees=trees)


def canonical_review(
    labels: DataFrame, nodes: DataFrame, edges: DataFrame, trees: int = models.TREES
) -> ReviewRun:
    """The short run on canonical tables: 35 % held out, budgets of 25, 50 and 100 %."""
    features = structure.join_labels(structure.simple_structural_features(nodes, edges), labels)
    store = materialize(structure.derived_signals(features), "store")
    return run_baselines(store, fraction=0.35, budgets=(0.25, 0.5, 1.0), trees=trees)


def explained_cases(
    scores: DataFrame,
    store: DataFrame,
    importance: DataFrame,
    model: str | None = None,
    quality: DataFrame | None = None,
    top_n: int = 15,
    k: int = 3,
) -> DataFrame:
    """Ranked queue with the strongest evidence of every case; every case must be matched."""
    chosen = ranking.select_model(scores, model, quality)
    queue = ranking.review_queue(scores, chosen)
    weights = evidence.candidate_features(importance, store, top_n)
    cases = materialize(evidence.case_evidence_topk(queue, store, weights, k), "cases")
    return evidence.require_evidence(cases)
