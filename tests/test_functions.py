"""Column expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskgraph.errors import IntegrityError
from riskgraph.functions import bins, labels, review


def apply(spark, rows, schema, expression):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expression.alias("out")).collect()]


def test_labels_are_trimmed_and_lowered(spark):
    raw = ["TRUE", " 1 ", "Illicit", " Suspicious", "0", "non-suspicious", "NonSuspicious", "", None, "2"]
    out = apply(spark, [(r,) for r in raw], "x string", labels.normalize_label(F.col("x")))
    assert out == [1, 1, 1, 1, 0, 0, 0, None, None, None]


def test_title_case_capitalises_after_any_non_letter(spark):
    raw = ["raw_random_forest", "tier_5_top_10pct", "ECE", "a-b"]
    out = apply(spark, [(r,) for r in raw], "x string", labels.title_case(F.col("x")))
    assert out == [r.replace("_", " ").title() for r in raw]


def test_display_name_prefers_the_given_name(spark):
    out = apply(
        spark, [("a_b",), ("c_d",)], "x string", labels.display_name(F.col("x"), {"a_b": "First"})
    )
    assert out == ["First", "C D"]


def test_quoted_names_reach_any_column(spark):
    df = spark.createDataFrame([(1, 2)], ["feat#1", "odd`name"])
    assert df.select(labels.column("feat#1"), labels.column("odd`name")).first() == (1, 2)


def test_feature_discovery_keeps_table_order_and_checks_the_count(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], ["clId", "feat#10", "feat#2"])
    assert labels.prefixed_features(df, expected=2) == ["feat#10", "feat#2"]
    with pytest.raises(IntegrityError):
        labels.prefixed_features(df, expected=43)
    names = df.select(*labels.renamed_features(["feat#10", "feat#2"], "node_feat")).columns
    assert names == ["node_feat_01", "node_feat_02"]


def test_required_and_numeric_columns(spark):
    df = spark.createDataFrame([(1, 0, 2, "x")], "component_id long, label int, n long, name string")
    assert labels.numeric_features(df) == ["n"]
    assert labels.missing_columns(df, ["component_id", "score"]) == ["score"]
    with pytest.raises(IntegrityError):
        labels.require_columns(df, ["score"])


def band(rank, total):
    share = rank / total
    for name, upper, _ in review.TIERS:
        if share <= upper:
            return name
    return "standard"


def test_tiers_floor_while_budgets_round_up(spark):
    total = 24362
    df = spark.range(1, total + 1).select(
        F.col("id").alias("rank"), review.priority_band(F.col("id"), F.lit(total)).alias("band")
    )
    counts = {r.band: r["count"] for r in df.groupBy("band").count().collect()}
    assert counts["tier_1_top_0_5pct"] == 121
    assert math.ceil(total * 0.005) == 122
    expected = {}
    for rank in range(1, total + 1):
        expected[band(rank, total)] = expected.get(band(rank, total), 0) + 1
    assert counts == expected


def test_four_significant_digits_follow_the_general_format(spark):
    rng = random.Random(7)
    values = [0.0, 2.0, 10.0, 100.0, 999.96, 1000.0, 9999.4, 12345.0, 0.0001, 0.00012345, 0.00001, -3.25, 1e100]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 12) for _ in range(500)]
    out = apply(spark, [(v,) for v in values], "x double", review.four_significant(F.col("x")))
    assert out == [f"{v:.4g}" for v in values]


def test_evidence_sentence(spark):
    rng = random.Random(3)
    rows = [
        ("node_count", rng.uniform(0, 500), rng.random(), rng.uniform(-4, 4), rng.random() / 5)
        for _ in range(300)
    ]
    text = review.evidence_text(*[F.col(c) for c in ("f", "v", "p", "z", "i")])
    out = apply(spark, rows, "f string, v double, p double, z double, i double", text)

    def expected(f, v, p, z, i):
        tail = f"top {(1 - p) * 100:.1f}" if p >= 0.5 else f"bottom {p * 100:.1f}"
        side = "above" if z >= 0 else "below"
        return (
            f"{f}: value={v:.4g}; {p * 100:.1f}th percentile ({tail}%); "
            f"{abs(z):.2f} SD {side} overall mean; global RF importance={i:.2%}"
        )

    assert out == [expected(*r) for r in rows]


def test_missing_value_reads_nan(spark):
    text = review.evidence_text(*[F.col(c) for c in ("f", "v", "p", "z", "i")])
    out = apply(
        spark, [("x", None, None, 0.0, 0.1)], "f string, v double, p double, z double, i double", text
    )
    assert out == [
        "x: value=nan; nanth percentile (bottom nan%); 0.00 SD above overall mean; "
        "global RF importance=10.00%"
    ]


def test_bins_close_on_the_right_and_include_zero(spark):
    scores = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 0.30000000000000010, 1.0, -0.1, 1.1, None]
    out = apply(spark, [(s,) for s in scores], "x double", bins.bin_index(F.col("x")))
    assert out == [0, 0, 1, 2, 2, 3, 9, None, None, None]
    assert bins.bin_names()[0] == "(-0.001, 0.1]" and bins.bin_names()[-1] == "(0.9, 1.0]"
