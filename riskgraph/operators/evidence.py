"""Case-level statistical evidence for a review queue.

The store is turned into one row per (component, feature) for the few globally important
features. Means and deviations come from one aggregation over the whole store;
percentiles from one ordered pass over the distinct values of each feature, so a value
that most components share is one row in the ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions import review
from riskgraph.functions.labels import column, require_columns
from riskgraph.operators import wide
from riskgraph.operators.linking import require_unique
from riskgraph.operators.ordering import running_totals
from riskgraph.operators.ranking import top_importance

# Queue columns carried into the long evidence table.
QUEUE_METADATA = ("rank", "component_id", "priority_band", "risk_score", "model", "score_type")


def candidate_features(importance: DataFrame, store: DataFrame, top_n: int = 15) -> dict[str, float]:
    """Importance of the top-n features that the store holds, most important first."""
    require_columns(importance, ("feature", "random_forest_importance"))
    rows = top_importance(importance, top_n).collect()
    present = set(store.columns)
    found = {r.feature: float(r.random_forest_importance) for r in rows if r.feature in present}
    if not found:
        raise IntegrityError("none of the important features exist in the store")
    return found


def long_values(store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``component_id, feature, value`` with NaN read as missing."""
    rows = wide.cells(store, features, ["component_id"], wide.without_nan)
    return rows.select("component_id", wide.name_of(features).alias("feature"), F.col(wide.VALUE).alias("value"))


def feature_moments(store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, mean, sd, n`` over the whole store: one row per feature."""
    return wide.moments(store, features).select("feature", "mean", "sd", "n")


def feature_zscores(store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``component_id, feature, value, zscore``; 0 where the deviation is 0 or not finite."""
    value = F.col(wide.VALUE)
    z = (value - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    finite = ~F.isnan(z) & (F.abs(z) != float("inf"))
    # One moment row per named feature.
    return (
        wide.cells(store, features, ["component_id"], wide.without_nan)
        .join(F.broadcast(wide.moments(store, features)), wide.PLACE)
        .select(
            "component_id",
            "feature",
            value.alias("value"),
            F.coalesce(F.when(finite, z), F.lit(0.0)).alias("zscore"),
        )
    )


def value_percentiles(store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, value, percentile`` per distinct value: average rank over ties / non-NULL rows."""
    values = (
        long_values(store, features)
        .filter("value IS NOT NULL")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    placed = running_totals(values, [F.col("value").asc()], {"rows_so_far": "rows"}, ["feature"])
    average_rank = F.col("rows_so_far") - (F.col("rows") - 1) / 2
    return placed.join(
        F.broadcast(feature_moments(store, features).select("feature", "n")), "feature"
    ).select("feature", "value", (average_rank / F.col("n")).alias("percentile"))


def average_rank_percentile(store: DataFrame, features: Sequence[str]) -> DataFrame:
    """``component_id, feature, value, percentile``; NULL where the value is NULL.

    The case rows are the left side of the join, so adaptive execution can split a value
    that holds a large share of them.
    """
    return long_values(store, features).join(
        value_percentiles(store, features), ["feature", "value"], "left"
    )


def feature_evidence(store: DataFrame, importance: dict[str, float]) -> DataFrame:
    """Value, percentile, z-score, importance and evidence score per (component, feature)."""
    features = list(importance)
    weights = store.sparkSession.createDataFrame(
        list(importance.items()), "feature string, importance double"
    )
    return (
        feature_zscores(store, features)
        .join(value_percentiles(store, features), ["feature", "value"], "left")
        .join(F.broadcast(weights), "feature")
        .withColumn("evidence_score", F.col("importance") * F.abs("zscore"))
    )


def case_evidence_topk(
    queue: DataFrame, store: DataFrame, importance: dict[str, float], k: int = 3
) -> DataFrame:
    """Queue rows with ``evidence``, an array of their k strongest features.

    A component's list has one entry per important feature, so it stays short whatever the
    data. Scores equal to nine places tie, as features may be twins but for the last bit of
    a sum; ties go to the more important feature, then to the name.
    """
    require_unique(store, ["component_id"])
    entry = F.struct(
        (-F.round("evidence_score", 9)).alias("by_score"),
        (-F.col("importance")).alias("by_importance"),
        "feature",
        "value",
        "percentile",
        "zscore",
        "importance",
        "evidence_score",
    )
    strongest = (
        feature_evidence(store, importance)
        .groupBy("component_id")
        .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("evidence"))
    )
    return queue.join(strongest, "component_id", "left")


def require_evidence(cases: DataFrame) -> DataFrame:
    """Fail when a queued component was not found in the store."""
    if not cases.filter("evidence IS NULL").isEmpty():
        raise IntegrityError("queued components without a row in the feature store")
    return cases


def evidence_wide(cases: DataFrame, k: int = 3) -> DataFrame:
    """Queue rows with ``evidence_1..k`` sentences, empty text where there are fewer."""

    # One sentence expression for the whole array keeps the generated code short.
    sentences = F.transform(
        "evidence",
        lambda e: review.evidence_text(
            e["feature"], e["value"], e["percentile"], e["zscore"], e["importance"]
        ),
    )
    kept = [c for c in cases.columns if c != "evidence"]
    return cases.withColumn("__sentences", sentences).select(
        *[column(c) for c in kept],
        *[
            F.coalesce(F.get("__sentences", F.lit(i)), F.lit("")).alias(f"evidence_{i + 1}")
            for i in range(k)
        ],
        F.lit(review.EVIDENCE_METHOD).alias("evidence_method"),
        F.lit(review.EVIDENCE_NOTE).alias("evidence_note"),
    )


def evidence_long(cases: DataFrame) -> DataFrame:
    """One row per queued component and evidence rank; a case without evidence keeps one row, with NULLs."""
    kept = [c for c in QUEUE_METADATA if c in cases.columns]
    rows = cases.select(*kept, F.posexplode_outer("evidence").alias("at", "e"))
    return rows.select(
        *kept,
        (F.col("at") + 1).alias("evidence_rank"),
        F.col("e.feature").alias("feature"),
        F.col("e.value").alias("feature_value"),
        F.col("e.percentile").alias("percentile"),
        F.col("e.zscore").alias("zscore"),
        F.abs("e.zscore").alias("absolute_zscore"),
        F.col("e.importance").alias("global_random_forest_importance"),
        F.col("e.evidence_score").alias("evidence_score"),
    )


def drop_helper_columns(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop columns by reserved prefix and add the constant method and note texts."""
    helpers = [c for c in df.columns if c.startswith(tuple(prefixes))]
    return df.drop(*helpers).withColumns(
        {
            "evidence_method": F.lit(review.EVIDENCE_METHOD),
            "evidence_note": F.lit(review.EVIDENCE_NOTE),
        }
    )
