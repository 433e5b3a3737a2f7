"""Seeded splits that come out the same on any cluster.

Rows are ordered by the md5 of ``id:seed`` within their class, and the first rows of each
class form the held-out part. Sizes are exact: ``ceil(n * fraction)`` rows, shared among
the classes by largest remainder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.ordering import global_rank
from riskgraph.operators.selection import hash_cuts


def hash_order(seed: Column | int, salt: str = "") -> Column:
    number = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat(F.col("component_id").cast("string"), F.lit(":"), number.cast("string"))
    return F.md5(F.concat(text, F.lit(salt)) if salt else text)


def class_quotas(store: DataFrame, fraction: float) -> DataFrame:
    """Held-out rows of each class (one row per label)."""
    counts = store.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    n_all = F.sum("n").over(every)
    sized = counts.withColumn("held", F.ceil(n_all * float(fraction))).withColumn("n_all", n_all)
    share = F.col("held") * F.col("n")
    split = sized.select(
        "label",
        "held",
        ((share - F.pmod(share, F.col("n_all"))) / F.col("n_all")).cast("long").alias("floor"),
        F.pmod(share, F.col("n_all")).alias("remainder"),
    )
    order = F.row_number().over(Window.orderBy(F.desc("remainder"), "label"))
    left = F.col("held") - F.sum("floor").over(every)
    return split.select(
        "label", (F.col("floor") + F.when(order <= left, 1).otherwise(0)).alias("quota")
    )


def stratified_split(
    store: DataFrame, fraction: float = 0.20, seed: int = 42, part: str = "is_test"
) -> DataFrame:
    """``store`` with a boolean column that marks the held-out rows.

    The last held-out row of each class is found by counting ids under prefixes of their hash;
    nothing is sorted. Those cut points (one per class) then mark the rows in place: a store
    with hundreds of columns is neither shuffled nor written.
    """
    ids = store.select("component_id", "label").withColumn("__order", hash_order(seed))
    # One quota per label value: the labels are 0 and 1.
    quotas = {r.label: r.quota for r in class_quotas(ids, fraction).collect() if r.label is not None}
    cuts = hash_cuts(ids, quotas, "label", "__order", "component_id")
    order, held = hash_order(seed), F.lit(False)
    for cut in cuts:
        before = (order < cut["__order"]) | (
            (order == cut["__order"]) & (F.col("component_id") <= F.lit(cut.component_id))
        )
        held = F.when(F.col("label") == cut.label, before).otherwise(held)
    return store.withColumn(part, held)


def three_way_split(
    store: DataFrame, test: float = 0.20, calibration: float = 0.25, seed: int = 42
) -> DataFrame:
    """``part``: test rows first, then calibration rows out of the rest with the next seed."""
    outer = stratified_split(store, test, seed)
    inner = stratified_split(outer.filter("NOT is_test"), calibration, seed + 1, "is_calibration")
    part = F.when(F.col("is_calibration"), "calibration").otherwise("train")
    return (
        outer.filter("is_test")
        .withColumn("part", F.lit("test"))
        .unionByName(inner.withColumn("part", part).drop("is_calibration"))
        .drop("is_test")
    )


def repeated_parts(store: DataFrame, seeds: Sequence[int], fraction: float = 0.20) -> DataFrame:
    """``seed, component_id, label, part`` for one split per seed."""
    ids = store.select("component_id", "label")
    part = F.when(F.col("is_test"), "test").otherwise("train")
    return reduce(
        DataFrame.unionByName,
        [
            stratified_split(ids, fraction, seed).select(
                F.lit(seed).cast("long").alias("seed"), "component_id", "label", part.alias("part")
            )
            for seed in seeds
        ],
    )


def split_audit(parts: DataFrame, keys: Sequence[str] = ("seed", "part")) -> DataFrame:
    """Rows and positives per split part."""
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("components"), F.sum("label").alias("positives")
    )


def shuffle_labels(train: DataFrame, seed: int = 42) -> DataFrame:
    """Training rows with their labels permuted; class counts stay as they are.

    The row at place i of one hash order receives the label at place i of another.
    """
    ids = train.select("component_id", "label")
    by_id = F.col("component_id").asc()
    places = global_rank(
        ids.select("component_id", hash_order(seed, ":row").alias("__order")),
        [F.col("__order").asc(), by_id],
        rank="__place",
    ).select("component_id", "__place")
    labels = global_rank(
        ids.withColumn("__order", hash_order(seed, ":label")), [F.col("__order").asc(), by_id], rank="__place"
    ).select("__place", F.col("label").alias("__label"))
    moved = places.join(labels, "__place").select("component_id", "__label")
    return (
        train.join(moved, "component_id")
        .withColumn("label", F.col("__label"))
        .drop("__label")
    )
