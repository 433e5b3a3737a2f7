"""Score calibration whose fits fold on Spark: a sigmoid from sums, an isotonic curve from mergeable levels.

Both fits start from one row per distinct score. Rows without a score or a label are left out
of a fit; a target row without a score keeps NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators.ordering import BLOCK, POSITION, frozen_blocks
from riskgraph.session import materialize

# Levels of so many neighbouring blocks are pooled by one task of the next round.
MERGED_BLOCKS = 16
MOST_STEPS = 100


def folded_scores(calibration: DataFrame) -> DataFrame:
    """``risk_score, weight, positives``: one row per distinct score."""
    rows = calibration.filter("risk_score IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy(F.col("risk_score").cast("double").alias("risk_score")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum("label").cast("double").alias("positives")
    )


@dataclass
class Sigmoid:
    """1 / (1 + exp(-(slope * score + intercept)))."""

    slope: float
    intercept: float

    def of(self, score: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * score + F.lit(self.intercept))))


def _sums(folded: DataFrame, at: Sigmoid) -> dict[str, float]:
    """Penalised loss, its gradient and its second derivatives at one curve: one aggregation."""
    x, n = F.col("risk_score"), F.col("weight")
    z = F.lit(at.slope) * x + F.lit(at.intercept)
    p = 1.0 / (1.0 + F.exp(-z))
    curve = n * p * (1.0 - p)
    gap = n * p - F.col("positives")
    row = folded.agg(
        F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("positives") * z).alias("loss"),
        F.sum(gap * x).alias("gs"),
        F.sum(gap).alias("gi"),
        F.sum(curve * x * x).alias("ss"),
        F.sum(curve * x).alias("si"),
        F.sum(curve).alias("ii"),
    ).first()
    found = {name: float(value) for name, value in row.asDict().items()}
    found["loss"] += at.slope**2 / 2
    found["gs"] += at.slope
    found["ss"] += 1.0
    return found


def fit_sigmoid(calibration: DataFrame, tolerance: float = 1e-13) -> Sigmoid:
    """Logistic curve of the score with a penalty of half the squared slope, by Newton's method.

    Every step is one aggregation to six sums, whatever the number of rows; a step that does
    not lower the loss is halved.
    """
    folded = materialize(folded_scores(calibration), "folded-scores")
    total = folded.agg(F.sum("weight").alias("n"), F.sum("positives").alias("pos")).first()
    if not total.n or not 0 < total.pos < total.n:
        raise IntegrityError("a calibration fit needs rows of both classes")
    best = Sigmoid(0.0, math.log(total.pos / (total.n - total.pos)))
    sums = _sums(folded, best)
    for _ in range(MOST_STEPS):
        det = sums["ss"] * sums["ii"] - sums["si"] ** 2
        step_slope = (sums["ii"] * sums["gs"] - sums["si"] * sums["gi"]) / det
        step_intercept = (sums["ss"] * sums["gi"] - sums["si"] * sums["gs"]) / det
        if abs(step_slope * sums["gs"] + step_intercept * sums["gi"]) <= tolerance * max(1.0, abs(sums["loss"])):
            break
        length = 1.0
        while length > 1e-6:
            tried = Sigmoid(best.slope - length * step_slope, best.intercept - length * step_intercept)
            found = _sums(folded, tried)
            if found["loss"] < sums["loss"]:
                break
            length /= 2
        else:
            break
        best, sums = tried, found
    return best


def sigmoid_calibration(calibration: DataFrame, target: DataFrame) -> DataFrame:
    """Fit a logistic curve on calibration scores; replace the target's scores."""
    curve = fit_sigmoid(calibration)
    return target.withColumn("risk_score", curve.of(F.col("risk_score").cast("double")))


LEVEL = "low double, high double, weight double, positives double"


def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels in order of score, pooled until their rates rise strictly.

    Levels that were pooled before may be pooled again: the result is that of all their rows.
    """
    held: list[list[float]] = []
    for frame in frames:
        for low, high, weight, positives in zip(
            *(frame[c].tolist() for c in ("low", "high", "weight", "positives")), strict=True
        ):
            # Rates are compared as products of counts, which are whole numbers.
            while held and held[-1][3] * weight >= positives * held[-1][2]:
                last = held.pop()
                low, weight, positives = last[0], weight + last[2], positives + last[3]
            held.append([low, high, weight, positives])
    yield pd.DataFrame(held, columns=["low", "high", "weight", "positives"])


def isotonic_levels(calibration: DataFrame, blocks: int | None = None) -> DataFrame:
    """``low, high, weight, positives`` of every level of the non-decreasing fit.

    Each range block of scores is pooled by itself; levels of neighbouring blocks are pooled
    round after round, MERGED_BLOCKS at a time, until one block is left. Whole counts allow at
    most about the 2/3 power of the rows as levels, which is what the last task holds.
    """
    points = folded_scores(calibration).select(
        F.col("risk_score").alias("low"), F.col("risk_score").alias("high"), "weight", "positives"
    )
    blocks = blocks or int(calibration.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = points
    while True:
        ranges = levels.repartitionByRange(blocks, "low").sortWithinPartitions("low")
        levels = materialize(ranges.mapInPandas(pool, LEVEL), "levels")
        if blocks == 1:
            return levels
        blocks = -(-blocks // MERGED_BLOCKS)


def level_values(levels: DataFrame, scores: DataFrame) -> DataFrame:
    """``risk_score, calibrated`` of distinct scores: linear between levels, flat outside them.

    Levels and scores are laid out in one order; every score takes the last level before it,
    and a block hands its last level to the blocks behind it. So nothing is gathered.
    """
    order = Window.orderBy("low")
    # As many rows as the fit has levels.
    steps = levels.select(
        F.when(F.lag("low").over(order).isNull(), F.lit(float("-inf"))).otherwise(F.col("low")).alias("key"),
        F.lit(0).alias("kind"),
        F.struct(
            "high",
            (F.col("positives") / F.col("weight")).alias("value"),
            F.lead("low").over(order).alias("next_low"),
            F.lead(F.col("positives") / F.col("weight")).over(order).alias("next_value"),
        ).alias("level"),
    )
    asked = scores.select(
        F.col("risk_score").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(steps.schema["level"].dataType).alias("level")
    )
    laid = frozen_blocks(steps.unionByName(asked), [F.col("key").asc(), F.col("kind").asc()])
    # One row per block.
    lasts = laid.filter("kind = 0").groupBy(BLOCK).agg(F.max_by("level", POSITION).alias("own"))
    every = laid.select(BLOCK).distinct().join(lasts, BLOCK, "left")
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    handed = every.select(F.col(BLOCK).alias("of_block"), F.last("own", ignorenulls=True).over(before).alias("handed"))
    inside = Window.partitionBy(BLOCK).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        laid.withColumn("level", F.last("level", ignorenulls=True).over(inside))
        .filter("kind = 1")
        .join(F.broadcast(handed), F.col(BLOCK) == F.col("of_block"))
        .select(F.col("key").alias("risk_score"), F.coalesce("level", "handed").alias("level"))
    )
    level = F.col("level")
    share = (F.col("risk_score") - level["high"]) / (level["next_low"] - level["high"])
    between = level["value"] + (level["next_value"] - level["value"]) * share
    inner = (F.col("risk_score") > level["high"]) & level["next_low"].isNotNull()
    return placed.select("risk_score", F.when(inner, between).otherwise(level["value"]).alias("calibrated"))


def isotonic_calibration(calibration: DataFrame, target: DataFrame, blocks: int | None = None) -> DataFrame:
    """Non-decreasing fit on calibration scores, held flat outside their range.

    The target's rows are the left side of the join, which adaptive execution may split
    where very many share a score.
    """
    levels = isotonic_levels(calibration, blocks)
    score = F.col("risk_score").cast("double").alias("risk_score")
    scores = target.filter("risk_score IS NOT NULL").select(score).distinct()
    curve = level_values(levels, scores).withColumnRenamed("risk_score", "__score")
    joined = target.join(curve, target["risk_score"].cast("double") == F.col("__score"), "left")
    return joined.select(*[F.col("calibrated").alias(c) if c == "risk_score" else target[c] for c in target.columns])
