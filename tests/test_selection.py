"""Selection by narrowing counts against sorting."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import metrics, selection, splits

SCHEMA = "model string, component_id long, risk_score double, label int"


def plain_budgets(rows, fractions):
    out = {}
    for model in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == model), key=lambda r: (-r[2], r[1], -r[3]))
        n, pos = len(own), sum(r[3] for r in own)
        for f in fractions:
            k = max(1, min(n, math.ceil(n * f)))
            hit = sum(r[3] for r in own[:k])
            out[model, f] = (k, hit, hit / k, hit / pos if pos else 0.0)
    return out


@pytest.mark.parametrize("scores", ["ties", "one", "skewed", "negative"])
def test_budgets_equal_sorting(spark, scores):
    rng = random.Random(scores)
    draw = {
        "ties": lambda: rng.choice([0.1, 0.2, 0.9]),
        "one": lambda: 0.5,
        "spread": rng.random,
        "skewed": lambda: rng.random() ** 40,
        "negative": lambda: -(10.0 ** rng.uniform(-300, 300)),
    }[scores]
    rows = [(rng.choice(["a", "b"]), rng.randrange(10**15, 10**15 + 3000), draw(), int(rng.random() < 0.2)) for _ in range(2500)]
    rows.append((None, 7, 0.5, 0))
    fractions = (0.0001, 0.005, 0.02, 0.1, 0.5, 1.0)
    found = metrics.review_budget_metrics(spark.createDataFrame(rows, SCHEMA).repartition(5), fractions).collect()
    got = {(r.model, r.review_fraction): (r.reviews, r.suspicious_captured, r.precision_at_budget, r.recall_at_budget) for r in found}
    assert got == plain_budgets(rows, fractions)


def test_neighbouring_ids_beyond_doubles_and_text_ids(spark):
    base = 2**62
    rows = [("m", base + i, 0.5, i % 3 == 0) for i in range(700)]
    rows = [(m, i, s, int(y)) for m, i, s, y in rows]
    wanted = plain_budgets(rows, (0.1, 0.3))
    df = spark.createDataFrame(rows, SCHEMA)
    for ids in (F.col("component_id"), F.concat(F.lit("C"), F.col("component_id").cast("string"))):
        found = metrics.review_budget_metrics(df.withColumn("component_id", ids), (0.1, 0.3)).collect()
        assert {(r.model, r.review_fraction): r.suspicious_captured for r in found} == {k: v[1] for k, v in wanted.items()}


def test_hash_cuts_equal_sorting(spark, monkeypatch):
    rows = [(i % 5 == 0, hashlib.md5(str(i % 900).encode()).hexdigest(), i % 900) for i in range(2000)]
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "label int, h string, id long").repartition(4)
    for few in (1000, 0):
        monkeypatch.setattr(selection, "FEW", few)
        for k in (1, 400):
            cuts = {r.label: (r.h, r.id) for r in selection.hash_cuts(df, {0: k, 1: k, 2: 0}, "label", "h", "id")}
            assert cuts == {label: sorted((h, i) for a, h, i in rows if a == label)[k - 1] for label in (0, 1)}


def test_split_sorts_and_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(splits, "global_rank", None)
    store = spark.range(3000).select(F.col("id").alias("component_id"), (F.col("id") % 40 == 0).cast("int").alias("label"))
    split = splits.stratified_split(store, 0.2)
    assert "rangepartitioning" not in split._jdf.queryExecution().toString()
    held = {(r.label, r.component_id) for r in split.filter("is_test").collect()}
    for label in (0, 1):
        ids = sorted((i for i in range(3000) if (i % 40 == 0) == label), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert {i for a, i in held if a == label} == set(ids[: len([1 for a, _ in held if a == label])])
    assert len(held) == 600
