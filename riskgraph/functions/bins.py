"""Equal-width score bins, closed on the right, the lowest edge included."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_edges(bins: int = 10) -> list[float]:
    """Edges on the float grid ``i * (1 / bins)``, ending at exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_index(score: Column, bins: int = 10) -> Column:
    """Bin 0..bins-1; NULL for scores outside [0, 1]."""
    inner = bin_edges(bins)[1:-1]
    index = F.lit(0)
    for edge in inner:
        index = index + (score > edge).cast("int")
    return F.when((score >= 0.0) & (score <= 1.0), index)


def _shortened(edge: float, digits: int) -> float:
    """Keep ``digits`` places, counted from the first nonzero one below 1."""
    if edge == 0:
        return edge
    places = digits
    if abs(edge) < 1:
        places = digits - 1 - math.floor(math.log10(abs(edge)))
    return round(edge, places)


def bin_names(bins: int = 10) -> list[str]:
    """Interval texts such as ``(0.1, 0.2]``; the first opens just below zero."""
    edges = bin_edges(bins)
    for digits in range(3, 20):
        shown = [_shortened(e, digits) for e in edges]
        if len(set(shown)) == len(shown):
            break
    shown[0] = shown[0] - 10.0**-digits
    return [f"({low}, {high}]" for low, high in zip(shown, shown[1:])]
