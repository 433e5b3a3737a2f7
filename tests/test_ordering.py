"""Global ranks and running sums against plain Python."""

import random

from pyspark.sql import functions as F

from riskgraph.operators.ordering import frozen_blocks, global_rank, running_totals


def test_rank_with_a_hot_score_is_exact_and_spread(spark):
    """A third of the rows share one score, yet no block holds much more than its share."""
    df = spark.range(60000).select(
        F.col("id").alias("component_id"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 1000) / 1000).alias("risk_score"),
    )
    order = [F.col("risk_score").desc(), F.col("component_id").asc()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = [r["count"] for r in frozen_blocks(df, order).groupBy("__block").count().collect()]
        ranked = global_rank(df, order, total="n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(blocks) == 4 and max(blocks) < 60000 / 4 * 1.5
    expected = sorted(((r.risk_score, r.component_id) for r in ranked), key=lambda t: (-t[0], t[1]))
    place = {key: i for i, key in enumerate(expected, 1)}
    assert all(r["rank"] == place[(r.risk_score, r.component_id)] and r.n == 60000 for r in ranked)


def test_rank_and_sums_restart_per_group(spark):
    rng = random.Random(5)
    rows = [(f"m{rng.randint(0, 2)}", i, rng.randint(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "model string, id long, v long")
    order = [F.col("v").desc(), F.col("id").asc()]
    ranks = {(r.model, r.id): r["rank"] for r in global_rank(df, order, ["model"]).collect()}
    sums = {
        (r.model, r.id): r.so_far
        for r in running_totals(df, order, {"so_far": "v"}, ["model"]).collect()
    }
    for model in ("m0", "m1", "m2"):
        total = 0
        mine = sorted((r for r in rows if r[0] == model), key=lambda r: (-r[2], r[1]))
        for place, (_, i, v) in enumerate(mine, 1):
            total += v
            assert ranks[(model, i)] == place and sums[(model, i)] == total


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert global_rank(df, [F.col("v").asc()]).count() == 0
    assert running_totals(df, [F.col("v").asc()], {"s": "v"}).count() == 0


def test_a_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    ranked = global_rank(df, [F.col("v").asc()], ["g"], total="n")
    assert {(r.g, r.v, r.rank, r.n) for r in ranked.collect()} == {(None, 1, 1, 2), (None, 2, 2, 2), ("a", 3, 1, 1)}
    summed = running_totals(df, [F.col("v").asc()], {"until": "v"}, ["g"])
    assert {(r.g, r.until) for r in summed.collect()} == {(None, 1), (None, 3), ("a", 3)}
