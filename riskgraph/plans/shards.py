"""A forest for any number of training rows: one ordinary forest per shard, scores averaged.

The rows are dealt into disjoint shards by a hash of their id, as many as it takes for a shard
to hold about ``models.FIT_ROWS`` rows. A forest is fitted on all rows of its shard; each
shard's scores are a stage, so a stopped run goes on with the next shard. Every training row
is used by exactly one forest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions.labels import numeric_features
from riskgraph.operators import models
from riskgraph.operators.linking import require_unique
from riskgraph.plans.stages import Stages


def shard_rows(train: DataFrame, shard: int, shards: int) -> DataFrame:
    return train.filter(F.pmod(F.xxhash64("component_id", F.lit("shard")), F.lit(shards)) == shard)


def sharded_forest_scores(
    train: DataFrame,
    target: DataFrame,
    folder: str,
    features: Sequence[str] | None = None,
    seed: int = 42,
    trees: int = models.TREES,
    shard_size: int = models.FIT_ROWS,
) -> DataFrame:
    """``component_id, label, risk_score, model`` of the target, averaged over the shards' forests.

    A shard must hold both classes; with fewer positives than that, take larger shards.
    """
    names = list(features) if features is not None else numeric_features(train)
    require_unique(target, ["component_id"])
    shards = max(1, -(-train.count() // shard_size))
    stages = Stages(train.sparkSession, folder, {"shards": shards, "seed": seed, "trees": trees, "features": names})

    def scores(shard: int) -> DataFrame:
        rows = shard_rows(train, shard, shards)
        if rows.select("label").distinct().count() < 2:
            raise IntegrityError(f"shard {shard} of {shards} has one class only")
        forest = models.fit_random_forest(rows, names, seed + shard, trees)
        return forest.score(target)

    parts = [stages.table(f"shard-{shard}", lambda: scores(shard)) for shard in range(shards)]
    if shards == 1:
        return parts[0]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy("component_id", "label", "model").agg(F.avg("risk_score").alias("risk_score")).select(
        "component_id", "label", "risk_score", "model"
    )
