"""Sigmoid and isotonic fits against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.operators import calibration

SCHEMA = "component_id long, label int, risk_score double"


def table(spark, rows):
    return spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(rows)], SCHEMA).repartition(3)


def noisy(seed, n, values):
    rng = random.Random(seed)
    return [(x := rng.choice(values), int(rng.random() < x)) for _ in range(n)]


def plain_isotonic(rows):
    """{score: level} by the min-max formula."""
    xs = sorted({x for x, _ in rows})
    n, p = [sum(a == x for a, _ in rows) for x in xs], [sum(y for a, y in rows if a == x) for x in xs]
    rate = lambda i, j: sum(p[i : j + 1]) / sum(n[i : j + 1])
    return {x: max(min(rate(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}


def test_isotonic_small_case(spark):
    cal = table(spark, [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1), (None, 1), (0.5, None)])
    ask = spark.createDataFrame([(i, 0, s) for i, s in enumerate((0.0, 0.15, 0.25, 0.35, 0.9, None, 0.15))], SCHEMA)
    out = {r.component_id: r.risk_score for r in calibration.isotonic_calibration(cal, ask).collect()}
    assert [out[i] for i in range(5)] == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])
    assert out[5] is None and out[6] == pytest.approx(0.25)


@pytest.mark.parametrize("blocks", [1, 40])
def test_isotonic_is_the_same_at_any_number_of_blocks(spark, blocks):
    rows = noisy(blocks, 1500, [i / 61 for i in range(62)])
    levels = calibration.isotonic_levels(table(spark, rows), blocks).collect()
    found = {}
    for x, _ in rows:
        (level,) = [r for r in levels if r.low <= x <= r.high]
        found[x] = level.positives / level.weight
    assert found == pytest.approx(plain_isotonic(rows), abs=1e-12)
    asked = spark.createDataFrame([(i, 0, x) for i, x in enumerate(sorted(found))], SCHEMA)
    out = calibration.isotonic_calibration(table(spark, rows), asked, blocks).collect()
    assert {r.component_id: r.risk_score for r in out} == pytest.approx({i: found[x] for i, x in enumerate(sorted(found))})


def test_levels_are_few(spark):
    """Whole counts leave far fewer levels than scores, so what the last task holds is small."""
    rows = spark.range(200_000).select(
        "id", (F.col("id") / 200_000).alias("risk_score"), (F.rand(3) < F.col("id") / 200_000).cast("int").alias("label")
    )
    assert calibration.isotonic_levels(rows, 20).count() < 2000


def test_sigmoid_is_optimal(spark):
    rows = noisy(5, 800, [0.02, 0.1, 0.3, 0.5, 0.8, 0.97])
    curve = calibration.fit_sigmoid(table(spark, [*rows, (None, 1), (0.5, None)]))
    gap = [(1 / (1 + math.exp(-(curve.slope * x + curve.intercept))) - y, x) for x, y in rows]
    assert abs(sum(g * x for g, x in gap) + curve.slope) < 1e-5 and abs(sum(g for g, _ in gap)) < 1e-5
    assert curve.slope > 0
    scored = calibration.sigmoid_calibration(table(spark, rows), table(spark, [(0.3, 1), (None, 1)])).collect()
    want = 1 / (1 + math.exp(-(curve.slope * 0.3 + curve.intercept)))
    assert {r.component_id: r.risk_score for r in scored} == {0: pytest.approx(want), 1: None}


def test_sigmoid_of_separable_and_huge_scores(spark):
    for scale in (1.0, 500.0):
        curve = calibration.fit_sigmoid(table(spark, [(scale * i / 40, int(i > 20)) for i in range(41)]))
        assert math.isfinite(curve.slope) and math.isfinite(curve.intercept) and curve.slope > 0


def test_one_class_is_refused(spark):
    for rows in ([], [(0.5, 1)] * 3, [(0.5, 0)] * 3):
        with pytest.raises(IntegrityError):
            calibration.fit_sigmoid(table(spark, rows) if rows else table(spark, [(0.1, 1)]).limit(0))


def test_isotonic_without_rows_gives_null(spark):
    none = table(spark, [(0.1, 1)]).limit(0)
    (row,) = calibration.isotonic_calibration(none, table(spark, [(0.5, 1)])).collect()
    assert row.risk_score is None
