"""Ranking quality, calibration and summaries of scored cases.

Input: one row per case with a group column (``model`` or ``method``), ``component_id``,
``risk_score`` and ``label`` (0/1). Curve metrics first fold the cases into one row per
group and distinct score, so tied cases never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from riskgraph.errors import IntegrityError
from riskgraph.functions.bins import bin_edges, bin_index, bin_names
from riskgraph.operators.ordering import global_rank, running_totals
from riskgraph.operators.ranking import score_order
from riskgraph.operators.selection import first_sums

# Shares of the ranking that can be reviewed, and the log-loss clip.
BUDGETS = (0.005, 0.01, 0.02, 0.05, 0.10)
CLIP = 1e-12


def _keys(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def budget_size(n: Column, fraction: float) -> Column:
    """Cases reviewed under a budget: ceil(n * fraction), at least 1, at most n."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(n * float(fraction))))


def review_budget_metrics(
    scored: DataFrame, fractions: Sequence[float] = BUDGETS, group: str | Sequence[str] = "model"
) -> DataFrame:
    """Captured positives, precision, recall and lift in the top share of each ranking.

    The top rows are found by narrowing ranges of scores, and of ids among tied scores, so
    that no ranking is sorted. Ids that are not whole numbers, and scores that are NULL or NaN,
    are ranked instead.
    """
    keys = _keys(group)
    score = F.col("risk_score")
    groups = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum("label").alias("__positives"),
        F.min("risk_score").alias("low"),
        F.max("risk_score").alias("high"),
        F.count_if(score.isNull() | F.isnan(score.cast("double")) | F.col("component_id").isNull()).alias("open"),
    ).collect()
    if not groups:
        raise IntegrityError("no scored cases")
    countable = isinstance(scored.schema["component_id"].dataType, IntegralType)
    if countable and isinstance(scored.schema["risk_score"].dataType, NumericType) and not any(g.open for g in groups):
        rows = _counted_shares(scored, keys, fractions, groups)
    else:
        rows = _ranked_shares(scored, keys, fractions)
    return _share_metrics(rows, keys)


def _counted_shares(scored: DataFrame, keys: list[str], fractions: Sequence[float], groups: list) -> DataFrame:
    """Group, size, positives, share, reviewed and captured cases: one row per group and share."""
    named = {tuple(g[c] for c in keys): g for g in groups}
    sizes = {
        name: [max(1, min(g["__n"], math.ceil(g["__n"] * float(f)))) for f in fractions] for name, g in named.items()
    }
    ranges = {name: (g.low, g.high) for name, g in named.items()}
    captured = first_sums(scored, keys, "risk_score", "component_id", "label", sizes, ranges)
    made = [
        (*name, g["__n"], g["__positives"], float(f), sizes[name][i], captured[name][i])
        for name, g in named.items()
        for i, f in enumerate(fractions)
    ]
    kinds = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in keys)
    return scored.sparkSession.createDataFrame(
        made, f"{kinds}, __n long, __positives long, review_fraction double, reviews long, suspicious_captured long"
    )


def _ranked_shares(scored: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """The same from a full ranking."""
    ranked = global_rank(scored, score_order(), keys, rank="__rank", total="__n")
    captured = [
        F.sum(F.when(F.col("__rank") <= budget_size(F.col("__n"), f), F.col("label")).otherwise(0)).alias(
            f"__captured_{i}"
        )
        for i, f in enumerate(fractions)
    ]
    sums = ranked.groupBy(*keys).agg(
        F.max("__n").alias("__n"), F.sum("label").alias("__positives"), *captured
    )
    entries = [
        F.struct(
            F.lit(float(f)).alias("review_fraction"),
            budget_size(F.col("__n"), f).alias("reviews"),
            F.col(f"__captured_{i}").alias("suspicious_captured"),
        )
        for i, f in enumerate(fractions)
    ]
    return sums.select(*keys, "__n", "__positives", F.inline(F.array(*entries)))


def _share_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    base = F.col("__positives") / F.col("__n")
    precision = F.col("suspicious_captured") / F.col("reviews")
    some = F.col("__positives") > 0
    return rows.select(
        *keys,
        "review_fraction",
        "reviews",
        "suspicious_captured",
        precision.alias("precision_at_budget"),
        F.when(some, F.col("suspicious_captured") / F.col("__positives")).otherwise(0.0).alias(
            "recall_at_budget"
        ),
        F.when(some, precision / base).otherwise(0.0).alias("lift_at_budget"),
    )


def score_counts(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    """Cases and positives per group and distinct score."""
    return scored.groupBy(*_keys(group), "risk_score").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("label").alias("positives")
    )


def _curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    return running_totals(
        score_counts(scored, keys),
        [F.col("risk_score").desc()],
        {"cases_so_far": "cases", "positives_so_far": "positives"},
        keys,
    )


def _average_precision() -> Column:
    """Sum over distinct scores of recall gained times precision reached; 0 without positives."""
    gained = F.sum(F.col("positives") * F.col("positives_so_far") / F.col("cases_so_far"))
    return F.when(F.sum("positives") > 0, gained / F.sum("positives")).otherwise(0.0)


def _roc_auc() -> Column:
    """Share of positive-negative pairs in the right order, ties half; NULL with one class."""
    negatives = F.col("cases") - F.col("positives")
    won = F.sum(negatives * (F.col("positives_so_far") - F.col("positives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum(negatives)
    return F.when(pairs > 0, won / F.nullif(pairs, F.lit(0.0)))


def _base_rate() -> Column:
    return F.sum("positives") / F.sum("cases")


def average_precision(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    keys = _keys(group)
    return _curve(scored, keys).groupBy(*keys).agg(_average_precision().alias("average_precision"))


def roc_auc(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    keys = _keys(group)
    return _curve(scored, keys).groupBy(*keys).agg(_roc_auc().alias("roc_auc"))


def global_metrics(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    """Average precision, ROC AUC and base rate from one ordered pass."""
    keys = _keys(group)
    return (
        _curve(scored, keys)
        .groupBy(*keys)
        .agg(
            _average_precision().alias("average_precision"),
            _roc_auc().alias("roc_auc"),
            _base_rate().alias("base_rate"),
        )
    )


def _squared_error(score: Column) -> Column:
    negatives = F.col("cases") - F.col("positives")
    return F.sum(F.col("positives") * F.pow(1 - score, 2) + negatives * F.pow(score, 2)) / F.sum("cases")


def ranking_and_brier(scored: DataFrame, group: str | Sequence[str]) -> DataFrame:
    """Global metrics plus the Brier score, as kept for every repeated split."""
    keys = _keys(group)
    return (
        _curve(scored, keys)
        .groupBy(*keys)
        .agg(
            _average_precision().alias("average_precision"),
            _roc_auc().alias("roc_auc"),
            _base_rate().alias("base_rate"),
            _squared_error(F.col("risk_score")).alias("brier_score"),
        )
    )


def brier_score(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    return scored.groupBy(*_keys(group)).agg(
        F.avg(F.pow(F.col("risk_score") - F.col("label"), 2)).alias("brier_score")
    )


def _clipped(score: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), score))


def log_loss(scored: DataFrame, group: str | Sequence[str] = "model") -> DataFrame:
    p = _clipped(F.col("risk_score"))
    return scored.groupBy(*_keys(group)).agg(
        F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss")
    )


def _bin_sums(source: DataFrame, keys: list[str], bins: int, cases: Column, positives: Column, scores: Column):
    """One row per group with an array entry per bin: nothing is lost when a bin is empty."""
    index = bin_index(F.col("risk_score"), bins)
    sums, entries = [], []
    for i in range(bins):
        here = index == i
        sums += [
            F.sum(F.when(here, cases).otherwise(0)).alias(f"__cases_{i}"),
            F.sum(F.when(here, positives).otherwise(0)).alias(f"__positives_{i}"),
            F.sum(F.when(here, scores).otherwise(0.0)).alias(f"__scores_{i}"),
        ]
        n = F.col(f"__cases_{i}")
        entries.append(
            F.struct(
                F.lit(i).cast("long").alias("bin_id"),
                n.alias("cases"),
                F.when(n > 0, F.col(f"__positives_{i}") / F.nullif(n, F.lit(0))).alias("observed_rate"),
                F.when(n > 0, F.col(f"__scores_{i}") / F.nullif(n, F.lit(0))).alias("mean_score"),
            )
        )
    return sums, F.array(*entries)


def _case_bins(scored: DataFrame, keys: list[str], bins: int) -> DataFrame:
    sums, entries = _bin_sums(scored, keys, bins, F.lit(1), F.col("label"), F.col("risk_score"))
    return scored.groupBy(*keys).agg(*sums).select(*keys, F.inline(entries))


def calibration_bins(
    scored: DataFrame, group: str | Sequence[str] = "model", bins: int = 10
) -> DataFrame:
    """Cases, observed rate, mean score and their gap for every bin, empty ones included."""
    keys = _keys(group)
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    at = F.col("bin_id").cast("int")
    return _case_bins(scored, keys, bins).select(
        *keys,
        "bin_id",
        F.get(edges, at).alias("lower"),
        F.get(edges, at + 1).alias("upper"),
        "cases",
        "observed_rate",
        "mean_score",
        F.abs(F.col("observed_rate") - F.col("mean_score")).alias("absolute_gap"),
    )


def reliability_table(
    scored: DataFrame, group: str | Sequence[str] = "model", bins: int = 10
) -> DataFrame:
    """The same bins named by their interval."""
    keys = _keys(group)
    names = F.array(*[F.lit(n) for n in bin_names(bins)])
    return _case_bins(scored, keys, bins).select(
        *keys,
        F.get(names, F.col("bin_id").cast("int")).alias("bin"),
        "cases",
        "observed_rate",
        "mean_score",
    )


def _gap_share(entries: Column) -> Column:
    """Gap of each bin weighted by its cases; NULL when no case falls into any bin."""
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda acc, b: acc + b["cases"])
    gaps = F.aggregate(
        entries,
        F.lit(0.0),
        lambda acc, b: acc
        + F.coalesce(b["cases"] * F.abs(b["observed_rate"] - b["mean_score"]), F.lit(0.0)),
    )
    return F.when(total > 0, gaps / F.nullif(total, F.lit(0)))


def expected_calibration_error(
    scored: DataFrame, group: str | Sequence[str] = "model", bins: int = 10
) -> DataFrame:
    keys = _keys(group)
    sums, entries = _bin_sums(scored, keys, bins, F.lit(1), F.col("label"), F.col("risk_score"))
    return scored.groupBy(*keys).agg(*sums).select(*keys, _gap_share(entries).alias("ece"))


def calibration_method_metrics(
    scored: DataFrame, group: str | Sequence[str] = "method", bins: int = 10
) -> DataFrame:
    """All ranking and calibration metrics per method, from one ordered pass."""
    keys = _keys(group)
    score = F.col("risk_score")
    p = _clipped(score)
    negatives = F.col("cases") - F.col("positives")
    sums, entries = _bin_sums(
        scored, keys, bins, F.col("cases"), F.col("positives"), score * F.col("cases")
    )
    return (
        _curve(scored, keys)
        .groupBy(*keys)
        .agg(
            _average_precision().alias("average_precision"),
            _roc_auc().alias("roc_auc"),
            _squared_error(score).alias("brier_score"),
            (
                -F.sum(F.col("positives") * F.log(p) + negatives * F.log(1 - p)) / F.sum("cases")
            ).alias("log_loss"),
            _base_rate().alias("base_rate"),
            *sums,
        )
        .select(
            *keys,
            "average_precision",
            "roc_auc",
            "brier_score",
            "log_loss",
            _gap_share(entries).alias("ece"),
            "base_rate",
        )
    )


def model_comparison(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """One row with two models side by side and their differences (first minus second)."""
    names = ("average_precision", "roc_auc", "base_rate")

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(name)))

    side = [of(first, n).alias(f"first_{n}") for n in names] + [
        of(second, n).alias(f"second_{n}") for n in names
    ]
    both = metrics.agg(*side)
    return both.select(
        F.lit(first).alias("first_model"),
        F.lit(second).alias("second_model"),
        "*",
        *[(F.col(f"first_{n}") - F.col(f"second_{n}")).alias(f"{n}_difference") for n in names],
    )


def repeat_summary(
    metrics: DataFrame, values: Sequence[str], group: str | Sequence[str] = "model"
) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each value per group."""
    statistics = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return metrics.groupBy(*_keys(group)).agg(
        *[fn(v).alias(f"{v}_{name}") for v in values for name, fn in statistics]
    )
