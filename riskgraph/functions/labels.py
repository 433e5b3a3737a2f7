"""Label normalisation, names and column lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.errors import IntegrityError

# Raw label texts and the class they stand for.
POSITIVE_LABELS = ("illicit", "suspicious", "1", "true")
NEGATIVE_LABELS = ("licit", "non-suspicious", "nonsuspicious", "0", "false")

# Parts of a feature name that hint at a leaked target.
TARGET_TOKENS = ("label", "target", "suspicious", "licit", "class")

KEY_COLUMNS = ("component_id", "label")


def clean_text(raw: Column) -> Column:
    return F.lower(F.trim(raw.cast("string")))


def normalize_label(raw: Column) -> Column:
    """1 for positive texts, 0 for negative ones, NULL for anything else."""
    text = clean_text(raw)
    return F.when(text.isin(*POSITIVE_LABELS), 1).when(text.isin(*NEGATIVE_LABELS), 0).cast("int")


def quoted(name: str) -> str:
    """Backtick-quote any column name, such as ``feat#1``."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def title_case(text: Column) -> Column:
    """``_`` becomes a blank; every run of letters gets a capital, as in ``Top 10Pct``."""
    words = F.split(F.translate(text, "_", " "), "(?<=[^A-Za-z])(?=[A-Za-z])")
    return F.array_join(F.transform(words, F.initcap), "")


def display_name(text: Column, names: Mapping[str, str]) -> Column:
    """A given display name, or the title-cased text."""
    shown = None
    for value, name in names.items():
        shown = F.when(text == value, name) if shown is None else shown.when(text == value, name)
    fallback = title_case(text)
    return fallback if shown is None else shown.otherwise(fallback)


def numeric_features(df: DataFrame, excluded: Sequence[str] = KEY_COLUMNS) -> list[str]:
    """Numeric columns in table order, keys and label left out."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded
    ]


def prefixed_features(df: DataFrame, prefix: str = "feat#", expected: int | None = None) -> list[str]:
    """Columns with the prefix in table order; a wrong count is an error."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if expected is not None and len(found) != expected:
        raise IntegrityError(f"expected {expected} columns named {prefix}*, found {len(found)}")
    return found


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise IntegrityError(f"missing columns: {missing}")
    return df


def target_like(name: Column) -> Column:
    """True where a feature name contains one of the target tokens, in any case."""
    return name.rlike("(?i)" + "|".join(re.escape(t) for t in TARGET_TOKENS))


def renamed_features(features: Sequence[str], prefix: str) -> list[Column]:
    """``feat#k`` in table order as ``<prefix>_01``, ``<prefix>_02``, ... in DOUBLE."""
    return [
        column(name).cast("double").alias(f"{prefix}_{i:02d}") for i, name in enumerate(features, 1)
    ]
