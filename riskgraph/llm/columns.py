"""Column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A table is broadcast only up to this many (short) rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Slow: for short strings."""
    return F.translate(text, UPPER, UPPER.lower())


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart when results are joined back."""
    return F.xxhash64(whole(text))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to be new to ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Null-safe equality of several columns, as a join condition."""
    condition = F.lit(True)
    for a, b in names.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
