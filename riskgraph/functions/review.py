"""Capacity tiers and the sentences shown to a reviewer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capacity tiers, upper share of the ranking, and chart label.
TIERS = (
    ("tier_1_top_0_5pct", 0.005, "Top 0.5%"),
    ("tier_2_top_1pct", 0.01, "0.5–1%"),
    ("tier_3_top_2pct", 0.02, "1–2%"),
    ("tier_4_top_5pct", 0.05, "2–5%"),
    ("tier_5_top_10pct", 0.10, "5–10%"),
)
STANDARD_TIER = ("standard", "Standard")
LEGACY_BANDS = ("critical", "high", "elevated", "standard")

# Texts written to every queue or evidence row.
SCORE_TYPE = "ranking_score_not_probability"
REASON_PREFIX = "model-ranked component in "
REASON_REVIEW = (
    "review component evidence before escalation; model score is not proof of criminal activity"
)
EVIDENCE_METHOD = (
    "top globally important node features ranked by feature_importance x absolute standardized deviation"
)
EVIDENCE_NOTE = (
    "Statistical review cues only. Features are anonymized; evidence does not establish causality, "
    "criminal activity, or a legal/regulatory determination."
)


def priority_band(rank: Column, total: Column) -> Column:
    """Tier by the share of the ranking at or above this row."""
    share = rank.cast("double") / total
    band = F.when(share <= TIERS[0][1], TIERS[0][0])
    for name, upper, _ in TIERS[1:]:
        band = band.when(share <= upper, name)
    return band.otherwise(STANDARD_TIER[0])


def tier_reason(band: Column) -> Column:
    return F.concat(F.lit(REASON_PREFIX), F.translate(band, "_", " "))


def fixed_digits(value: Column, digits: int) -> Column:
    """Text of a value >= 0 with a fixed number of digits after the point, ties to even.

    The value is scaled in double precision before it is rounded, so a value that is not a
    tie but lies within the last bit of one may round the other way than an exact formatter.
    """
    base = 10**digits
    scaled = F.rint(value * float(base)).cast("long")
    rest = F.pmod(scaled, F.lit(base))
    whole = ((scaled - rest) / base).cast("long").cast("string")
    return F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def four_significant(value: Column) -> Column:
    """Shortest text with four significant digits: plain from 1e-4 to 9999, else exponent.

    Ties go to even, with the same limit as in :func:`fixed_digits`.
    """
    size = F.abs(value)
    first = F.floor(F.log10(size))
    # Only whole powers of ten, which are exact.
    power_of_ten = F.pow(F.lit(10.0), F.abs(3 - first).cast("double"))
    raw = F.rint(F.when(first > 3, size / power_of_ten).otherwise(size * power_of_ten))
    carried = raw >= 10000
    digits = F.when(carried, F.lit(1000)).otherwise(raw).cast("long")
    power = F.when(carried, first + 1).otherwise(first)

    def split(places: int) -> Column:
        base = 10**places
        rest = F.pmod(digits, F.lit(base))
        whole = ((digits - rest) / base).cast("long").cast("string")
        return F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), places, "0"))

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, "\\.?0+$", "")

    step = F.abs(power)
    exponent = F.concat(
        F.lit("e"),
        F.when(power < 0, "-").otherwise("+"),
        F.when(step < 10, "0").otherwise(""),
        step.cast("string"),
    )
    small = F.concat(
        F.lit("0."), F.repeat(F.lit("0"), (-power - 1).cast("int")), digits.cast("string")
    )
    text = (
        F.when(power == 3, digits.cast("string"))
        .when(power == 2, trimmed(split(1)))
        .when(power == 1, trimmed(split(2)))
        .when(power == 0, trimmed(split(3)))
        .when((power >= -4) & (power < 0), trimmed(small))
        .otherwise(F.concat(trimmed(split(3)), exponent))
    )
    signed = F.concat(F.when(value < 0, "-").otherwise(""), text)
    return F.when(value == 0, "0").otherwise(signed)


def evidence_text(
    feature: Column, value: Column, percentile: Column, zscore: Column, importance: Column
) -> Column:
    """One sentence: value, percentile, tail, distance from the mean, global importance.

    A missing value or percentile reads ``nan``.
    """

    def shown(text: Column) -> Column:
        return F.coalesce(text, F.lit("nan"))

    tail = F.when(
        percentile >= 0.5, F.concat(F.lit("top "), fixed_digits((1 - percentile) * 100, 1))
    ).otherwise(F.concat(F.lit("bottom "), shown(fixed_digits(percentile * 100, 1))))
    return F.concat(
        feature,
        F.lit(": value="),
        shown(four_significant(value)),
        F.lit("; "),
        shown(fixed_digits(percentile * 100, 1)),
        F.lit("th percentile ("),
        tail,
        F.lit("%); "),
        fixed_digits(F.abs(zscore), 2),
        F.when(zscore >= 0, " SD above").otherwise(" SD below"),
        F.lit(" overall mean; global RF importance="),
        fixed_digits(importance * 100, 2),
        F.lit("%"),
    )
