"""Review queue, model choice and top-n selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions import review
from riskgraph.operators.ordering import global_rank


def score_order() -> list:
    """Highest score first; tied scores by component id, so that a rerun gives the same rows."""
    return [F.col("risk_score").desc(), F.col("component_id").asc()]


def models_by_precision(metrics: DataFrame) -> DataFrame:
    """One row: the model with the highest average precision."""
    return metrics.agg(
        F.max_by("model", F.struct("average_precision", "model")).alias("model"),
        F.max("average_precision").alias("average_precision"),
    )


def select_model(scores: DataFrame, requested: str | None = None, metrics: DataFrame | None = None) -> str:
    """The requested model, else the best by average precision, else the only one scored."""
    chosen = requested
    if chosen is None and metrics is not None:
        best = models_by_precision(metrics).first()
        chosen = best.model if best else None
    if chosen is None:
        models = scores.select("model").dropna().distinct().limit(2).collect()
        chosen = models[0].model if len(models) == 1 else None
    if chosen is None:
        raise IntegrityError("name a model or give a metrics table to choose from")
    if scores.filter(F.col("model") == chosen).isEmpty():
        raise IntegrityError(f"model {chosen!r} has no scores")
    return chosen


def review_queue(scores: DataFrame, model: str) -> DataFrame:
    """All cases of one model, ranked, with capacity tier and reason texts."""
    ranked = global_rank(scores.filter(F.col("model") == model), score_order(), total="total")
    band = review.priority_band(F.col("rank"), F.col("total"))
    return (
        ranked.withColumn("review_fraction_rank", F.col("rank") / F.col("total"))
        .withColumn("priority_band", band)
        .withColumns(
            {
                "score_type": F.lit(review.SCORE_TYPE),
                "reason_1": review.tier_reason(F.col("priority_band")),
                "reason_2": F.lit(review.REASON_REVIEW),
            }
        )
        .drop("total")
    )


def top_importance(importance: DataFrame, n: int) -> DataFrame:
    """The n most important features; equal importance by name."""
    return (
        importance.dropna(subset=["feature", "random_forest_importance"])
        .orderBy(F.desc("random_forest_importance"), "feature")
        .limit(n)
    )


def top_separation(separation: DataFrame, n: int = 15) -> DataFrame:
    return separation.orderBy(F.desc("abs_standardized_mean_difference"), "feature").limit(n)


def top_cases(evidence: DataFrame, n: int) -> DataFrame:
    """The n best-ranked cases of a long evidence table, one row each."""
    return evidence.select("rank", "component_id").distinct().orderBy("rank", "component_id").limit(n)


def best_calibration_method(metrics: DataFrame, raw: str) -> DataFrame:
    """One row: method with the lowest Brier score, and the raw method's Brier score and ECE."""
    is_raw = F.col("method") == raw
    return metrics.agg(
        F.min_by("method", F.struct("brier_score", "method")).alias("best_brier_method"),
        F.min("brier_score").alias("best_brier_score"),
        F.max(F.when(is_raw, F.col("brier_score"))).alias("raw_brier_score"),
        F.max(F.when(is_raw, F.col("ece"))).alias("raw_ece"),
    )
