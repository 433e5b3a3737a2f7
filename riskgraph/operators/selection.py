"""The k-th row of an order, and sums in front of it, by narrowing counts instead of a sort.

Every pass counts the rows of each open interval in bins (a bin is a part of a number range or
the next digits of a hash), and the bin that holds the k-th row is the next interval. Passes
read narrow columns and send one row per task and bin; nothing is sorted, written or dealt by
range, and the driver sees a bounded number of bins. Two or three passes reach a single value
of a hash, a few more one of a number; a pass costs the same whatever rows are tied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
# Hexadecimal digits that a pass adds, and rows that are looked at one by one in the end.
DIGITS = 3
FEW = 1000


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def hash_cuts(rows: DataFrame, wanted: Mapping, group: str, order: str, tie: str) -> list:
    """Rows (``group``, ``order``, ``tie``): the k-th of each group, ``wanted`` {group: k}, by (order, tie).

    ``order`` is a hash in lower-case hexadecimal digits of one length.
    """
    open_ = {g: ("", k) for g, k in wanted.items() if k > 0}
    closed: dict = {}

    def members(of: Mapping) -> Column:
        return any_of([(F.col(group) == g) & F.col(order).startswith(prefix) for g, (prefix, _) in of.items()])

    while open_:
        length = len(next(iter(open_.values()))[0]) + DIGITS
        bins = (
            rows.filter(members(open_)).groupBy(group, F.substring(order, 1, length).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")).collect()
        )
        narrowed = {}
        for g, (before, k) in open_.items():
            for row in sorted((b for b in bins if b[group] == g), key=lambda b: b.bin):
                if k <= row.n:
                    # A bin that did not get longer holds one hash only.
                    done = row.n <= FEW or row.bin == before
                    (closed if done else narrowed)[g] = (row.bin, k)
                    break
                k -= row.n
        open_ = narrowed
    last = rows.filter(members(closed)).groupBy(group, order, tie).agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = []
    for g, (_, k) in closed.items():
        for row in sorted((r for r in last if r[group] == g), key=lambda r: (r[order], r[tie])):
            if k <= row.n:
                cuts.append(row)
                break
            k -= row.n
    return cuts


@dataclass
class Target:
    """The first ``k`` rows of a group; ``taken`` is the sum over those that are settled."""

    group: tuple
    k: int
    low: object = None
    high: object = None
    taken: int = 0
    settled: bool = False


def _narrow(rows: DataFrame, keys: Sequence[str], value: str, weight: str, targets: Sequence[Target]) -> None:
    """Settle targets or narrow them to one value; ``rows`` come in descending order of ``value``."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*keys, value)}
    schema = ", ".join([*[f"`__{c}` {kinds[c]}" for c in keys], f"__low {kinds[value]}", f"__high {kinds[value]}"])
    while True:
        open_ = [t for t in targets if not t.settled and t.low != t.high]
        if not open_:
            return
        intervals = sorted({(*t.group, t.low, t.high) for t in open_}, key=repr)
        # At most one row per target.
        inside = F.broadcast(rows.sparkSession.createDataFrame(intervals, schema))
        condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.lit(True))
        within = condition & (F.col(value) >= F.col("__low")) & (F.col(value) <= F.col("__high"))
        high, low = F.col("__high").cast("double"), F.col("__low").cast("double")
        share = F.coalesce((high - F.col(value).cast("double")) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins: dict = {}
        for r in (
            rows.join(inside, within).groupBy(*[f"__{c}" for c in keys], "__low", "__high", place.alias("place"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"), F.min(value).alias("low"), F.max(value).alias("high"))
            .collect()
        ):
            bins.setdefault(tuple(r[: len(keys) + 2]), []).append(r)
        for t in open_:
            found = sorted(bins[(*t.group, t.low, t.high)], key=lambda r: r.place)
            stuck = len(found) == 1 and (found[0].low, found[0].high) == (t.low, t.high)
            if stuck:
                # Neighbouring whole numbers that are one double: a few at most, taken one by one.
                match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(keys, t.group)], F.lit(True))
                near = rows.filter(match & F.col(value).between(t.low, t.high)).groupBy(F.col(value).alias("low"))
                found = near.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight")).withColumn("high", F.col("low")).collect()
                found.sort(key=lambda r: r.low, reverse=True)
            for r in found:
                if t.k < r.n:
                    t.low, t.high = r.low, r.high
                    break
                t.k, t.taken = t.k - r.n, t.taken + (r.weight or 0)
                if not t.k:
                    t.settled = True
                    break


def first_sums(
    rows: DataFrame, keys: Sequence[str], value: str, tie: str, weight: str, sizes: Mapping[tuple, Sequence[int]],
    ranges: Mapping[tuple, tuple],
) -> dict[tuple, list[int]]:
    """Per group, the sum of ``weight`` over its first k rows by (``value`` descending, ``tie`` ascending).

    ``sizes`` has the k of each group, at most its rows, ``ranges`` its smallest and largest
    value. Both columns hold numbers without NULL and NaN.
    """
    targets = {g: [Target(g, k, *ranges[g]) for k in ks] for g, ks in sizes.items()}
    flat = [t for ts in targets.values() for t in ts]
    _narrow(rows, keys, value, weight, flat)
    # What is left stands at one value: its rows are told apart by the tie, smallest first.
    tied = [t for t in flat if not t.settled]
    if tied:
        kind = rows.schema[value].dataType.simpleString()
        schema = ", ".join([*[f"`__{c}` {rows.schema[c].dataType.simpleString()}" for c in keys], f"__at {kind}"])
        at = F.broadcast(rows.sparkSession.createDataFrame(sorted({(*t.group, t.low) for t in tied}, key=repr), schema))
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.col(value) == F.col("__at"))
        inner = rows.join(at, match).select(*keys, F.col(value).alias("__at"), (-F.col(tie)).alias("__tie"), weight)
        spans = inner.groupBy(*keys, "__at").agg(F.min("__tie").alias("low"), F.max("__tie").alias("high")).collect()
        span = {tuple(r[: len(keys) + 1]): (r.low, r.high) for r in spans}
        again = []
        for t in tied:
            low, high = span[(*t.group, t.low)]
            again.append(Target((*t.group, t.low), t.k, low, high))
        _narrow(inner, [*keys, "__at"], "__tie", weight, again)
        # Rows that repeat a value and a tie cannot be told apart: weight comes first among them.
        rest = [a for a in again if not a.settled]
        sums = {}
        if rest:
            match = any_of([
                reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip([*keys, "__at", "__tie"], (*a.group, a.low))])
                for a in rest
            ])
            for r in inner.filter(match).groupBy(*keys, "__at", "__tie").agg(F.sum(weight).alias("weight")).collect():
                sums[tuple(r[: len(keys) + 2])] = r.weight or 0
        for t, a in zip(tied, again, strict=True):
            t.taken += a.taken + (0 if a.settled else min(a.k, sums[(*a.group, a.low)]))
    return {g: [t.taken for t in ts] for g, ts in targets.items()}
