"""Stacked result tables and the data behind the charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions.labels import display_name, title_case
from riskgraph.functions.review import LEGACY_BANDS, STANDARD_TIER, TIERS
from riskgraph.operators.ranking import top_cases

# Display names of metrics and feature stages.
METRIC_NAMES = {
    "brier_score": "Brier score",
    "log_loss": "Log loss",
    "ece": "ECE",
    "average_precision": "PR-AUC",
    "roc_auc": "ROC-AUC",
}
STAGES = ("Structure", "Structure + node", "Structure + node + edge")
FEATURE_SETS = ("Node only", "Node + edge")
BUDGET_COLUMNS = (
    "benchmark",
    "review_fraction",
    "reviews",
    "suspicious_captured",
    "precision_at_budget",
    "recall_at_budget",
    "lift_at_budget",
)


def union_model_results(results: Mapping[str, DataFrame], tag: str = "model") -> DataFrame:
    """Stack result tables, each marked with its name."""
    return reduce(
        DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in results.items()]
    )


def benchmark_budget_union(results: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the shared budget columns of several benchmarks."""
    return union_model_results(results, "benchmark").select(*BUDGET_COLUMNS)


def humanize_labels(df: DataFrame, source: str, names: Mapping[str, str] = {}) -> DataFrame:
    """Display label of a name column, from a fixed map or title-cased."""
    return df.withColumn(f"{source}_label", display_name(F.col(source), names))


def metrics_long(metrics: DataFrame, values: Sequence[str], key: str = "method") -> DataFrame:
    """One row per key and metric, with display names."""
    return (
        metrics.unpivot([key], list(values), "metric", "value")
        .withColumn(f"{key}_label", title_case(F.col(key)))
        .withColumn("metric_label", display_name(F.col("metric"), METRIC_NAMES))
    )


def case_feature_pivot(
    evidence: DataFrame, cases: int, value: str = "zscore", features: Sequence[str] | None = None
) -> DataFrame:
    """Top cases by feature, columns in order of mean evidence score.

    An evidence table has one row per case and feature, so the smallest value is the value.
    """
    top = top_cases(evidence, cases)
    # At most ``cases`` rows.
    subset = evidence.join(F.broadcast(top), ["rank", "component_id"], "left_semi")
    names = list(features) if features is not None else [
        r.feature
        for r in subset.groupBy("feature")
        .agg(F.avg("evidence_score").alias("score"))
        .orderBy(F.desc("score"), "feature")
        .collect()
    ]
    return (
        subset.groupBy("rank", "component_id").pivot("feature", names).agg(F.min(value)).orderBy("rank")
    )


def evidence_frequency(evidence: DataFrame, n: int) -> DataFrame:
    """How often each feature is named in the first tier; the n most frequent."""
    first = evidence.filter(F.col("priority_band") == TIERS[0][0])
    return (
        first.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("evidence_mentions"))
        .orderBy(F.desc("evidence_mentions"), "feature")
        .limit(n)
    )


def band_counts(queue: DataFrame) -> DataFrame:
    """Cases per tier in tier order, 0 when empty; older queues fall back to ``risk_band``."""
    if "priority_band" in queue.columns:
        bands = [(name, label) for name, _, label in TIERS] + [STANDARD_TIER]
        source = "priority_band"
    else:
        bands = [(name, name.title()) for name in LEGACY_BANDS]
        source = "risk_band"
    counted = queue.agg(
        *[F.count_if(F.col(source) == name).alias(f"c{i}") for i, (name, _) in enumerate(bands)]
    )
    entries = [
        F.struct(
            F.lit(i).cast("long").alias("tier_order"),
            F.lit(label).alias("priority_tier"),
            F.col(f"c{i}").alias("cases"),
        )
        for i, (_, label) in enumerate(bands)
    ]
    return counted.select(F.inline(F.array(*entries)))


def evidence_strength_by_rank(evidence: DataFrame) -> DataFrame:
    """Mean evidence score and largest deviation per case, first tenth of the ranks."""
    cases = evidence.groupBy("rank", "component_id", "priority_band", "risk_score").agg(
        F.avg("evidence_score").alias("mean_evidence_score"),
        F.max("absolute_zscore").alias("max_absolute_zscore"),
    )
    total = evidence.agg(F.count_distinct("rank", "component_id").alias("n")).first().n
    return cases.filter(F.col("rank") <= max(1, int(total * 0.10))).orderBy("rank")


def feature_stage_table(stage_metrics: Sequence[DataFrame], models: Sequence[str]) -> DataFrame:
    """Average precision and ROC AUC per feature stage and model."""
    if len(stage_metrics) != len(STAGES):
        raise IntegrityError(f"expected metrics of {len(STAGES)} stages")
    rows = [
        df.filter(F.col("model").isin(*models)).select(
            F.lit(stage).alias("feature_stage"),
            title_case(F.col("model")).alias("model"),
            F.col("average_precision").alias("pr_auc"),
            "roc_auc",
        )
        for stage, df in zip(STAGES, stage_metrics)
    ]
    return reduce(DataFrame.unionByName, rows)


def feature_set_comparison(summaries: Sequence[DataFrame], model: str) -> DataFrame:
    """Repeated-split means of one model on both feature sets."""
    rows = [
        df.filter(F.col("model") == model).select(
            F.lit(name).alias("feature_set"),
            F.col("average_precision_mean").alias("pr_auc_mean"),
            F.col("average_precision_std").alias("pr_auc_std"),
            "roc_auc_mean",
        )
        for name, df in zip(FEATURE_SETS, summaries)
    ]
    return reduce(DataFrame.unionByName, rows)


def feature_set_budgets(budgets: Sequence[DataFrame], model: str) -> DataFrame:
    """Budget summaries of one model on both feature sets, with the budget in percent."""
    rows = [
        df.filter(F.col("model") == model).withColumn("feature_set", F.lit(name))
        for name, df in zip(FEATURE_SETS, budgets)
    ]
    return reduce(DataFrame.unionByName, rows).withColumn(
        "review_budget_pct", F.col("review_fraction") * 100
    )


def budget_curve_table(budgets: DataFrame, key: str = "model", names: Mapping[str, str] = {}) -> DataFrame:
    """Budget rows with percent and display label, in label and budget order."""
    return (
        budgets.withColumn("review_budget_pct", F.col("review_fraction") * 100)
        .withColumn(f"{key}_label", display_name(F.col(key), names))
        .orderBy(f"{key}_label", "review_budget_pct")
    )
