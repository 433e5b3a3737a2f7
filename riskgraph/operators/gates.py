"""Class separation, feature dominance and the validation verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import numeric_features
from riskgraph.operators import wide
from riskgraph.operators.profile import one_row

# Limits of the validation checks.
MAX_RELATIVE_SPREAD = 0.10
MIN_LIFT_OVER_BASE = 10
MAX_SHUFFLED_OVER_BASE = 2
MAX_SHUFFLED_ROC_GAP = 0.10
DOMINANT_TOP_1 = 0.50
DOMINANT_TOP_10 = 0.90
GATE_BUDGET = 0.005


def class_separation(store: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Mean per class and standardised difference of every feature, widest first."""
    names = list(features) if features is not None else numeric_features(store)
    value = F.col(wide.VALUE)
    stats = wide.per_feature(
        store,
        names,
        [
            F.avg(F.when(F.col("label") == 0, value)).alias("licit_mean"),
            F.avg(F.when(F.col("label") == 1, value)).alias("suspicious_mean"),
            F.stddev_pop(value).alias("sd"),
        ],
        keep=["label"],
    )
    difference = (F.col("suspicious_mean") - F.col("licit_mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return (
        stats.select(
            "feature",
            "licit_mean",
            "suspicious_mean",
            F.coalesce(difference, F.lit(0.0)).alias("standardized_mean_difference"),
        )
        .withColumn("abs_standardized_mean_difference", F.abs("standardized_mean_difference"))
        .orderBy(F.desc("abs_standardized_mean_difference"), "feature")
    )


def dominance_review(importance: DataFrame) -> DataFrame:
    """One row: top feature, its importance, the ten largest together, and a review flag."""
    top = (
        importance.dropna(subset=["feature", "random_forest_importance"])
        .orderBy(F.desc("random_forest_importance"), "feature")
        .limit(10)
    )
    value = F.col("random_forest_importance")
    return top.agg(
        # Equal importance: the first name in alphabetical order, as in the ordering above.
        F.min_by("feature", F.struct((-value).alias("v"), F.col("feature"))).alias("top_feature"),
        F.max(value).alias("top_feature_importance"),
        F.sum(value).alias("top_10_cumulative_importance"),
    ).withColumn(
        "manual_review_recommended",
        (F.col("top_feature_importance") >= DOMINANT_TOP_1)
        | (F.col("top_10_cumulative_importance") >= DOMINANT_TOP_10),
    )


def validation_gate(
    summary: DataFrame,
    budget_summary: DataFrame,
    permutation: DataFrame,
    audit: DataFrame,
    model: str = "random_forest",
) -> DataFrame:
    """One row: three hard checks, the numbers behind them, and the status.

    ``summary``, ``budget_summary`` and ``permutation`` have one row per model (and budget),
    ``audit`` has one row. A missing row leaves NULLs, and its check does not pass.
    """
    repeated = summary.filter(F.col("model") == model).select(
        "model",
        "average_precision_mean",
        "average_precision_std",
        "average_precision_min",
        "roc_auc_mean",
    )
    shuffled = permutation.filter(F.col("model") == model).select(
        F.col("average_precision").alias("permuted_average_precision"),
        F.col("roc_auc").alias("permuted_roc_auc"),
        "base_rate",
    )
    top = budget_summary.filter(
        (F.col("model") == model) & (F.col("review_fraction") == GATE_BUDGET)
    ).select(
        F.col("precision_at_budget_mean").alias("top_0_5_percent_precision_mean"),
        F.col("lift_at_budget_mean").alias("top_0_5_percent_lift_mean"),
        F.col("suspicious_captured_mean").alias("top_0_5_percent_suspicious_captured_mean"),
    )
    schema = audit.select(
        (
            (F.col("duplicate_component_ids") == 0)
            & (F.col("nonfinite_feature_values") == 0)
            & (F.col("potential_target_name_columns") == "")
        ).alias("schema_leakage_audit_pass"),
    )
    row = one_row([repeated, shuffled, top, schema])
    base = F.col("base_rate")
    steady = (
        F.try_divide("average_precision_std", "average_precision_mean") < MAX_RELATIVE_SPREAD
    ) & (F.col("average_precision_min") > base * MIN_LIFT_OVER_BASE)
    collapsed = (F.col("permuted_average_precision") <= base * MAX_SHUFFLED_OVER_BASE) & (
        F.abs(F.col("permuted_roc_auc") - 0.5) <= MAX_SHUFFLED_ROC_GAP
    )
    return (
        row.withColumn("repeated_split_stability_pass", F.coalesce(steady, F.lit(False)))
        .withColumn("permutation_sanity_pass", F.coalesce(collapsed, F.lit(False)))
        .withColumn(
            "status",
            F.when(
                F.col("repeated_split_stability_pass")
                & F.col("permutation_sanity_pass")
                & F.coalesce("schema_leakage_audit_pass", F.lit(False)),
                "hard_checks_pass",
            ).otherwise("review_required"),
        )
    )
