"""Periodic runs: stretches of words that repeat with a period, by Lyndon roots.

The first phase of Baier's suffix sorter groups the suffixes of a sequence by the longest
Lyndon word that starts there, so its groups give the Lyndon array directly. It runs under
an order of the words and under the reversed order. By the runs theorem every run shows its
root among the Lyndon words of one of the two orders, followed by its own copy if the run has
three periods. Roots are extended to both sides as far as words one period apart are equal
(longest common extensions), which gives the run.

Only runs of at least LEAST words and COPIES periods are reported. In such a run every
window of LEAST - 15 (nine) words occurs again in the same run. So the sorter is given the
stretches of a text that windows occurring twice in it cover, of many texts at once with
separators that occur nowhere else; a run lies in one stretch as a whole, and other texts
have none.

Extensions are searched by 64-bit prefix hashes, all roots at once, and every run is then
compared word for word; one that does not hold is extended anew by comparing words. Work
grows with a text's words, memory too: a text is one row and is never split.

Words are the pieces between spaces, tabs, line feeds and their kin, unchanged. Null text
has no words. Rows get a result each, whatever their ids. An empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskgraph.llm.columns import fresh, whole

LEAST = 24
COPIES = 3
WINDOW = 9
# Bytes of text that are held as words at once; a longer text is held alone.
BATCH_BYTES = 2_000_000
# Odd factor of the prefix hashes and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place of a sequence of ranks 0, 1, ...

    Groups of suffixes are taken in descending order. The nearest place to the left of a
    member that lies in a lower group continues its own Lyndon word with the member's; the
    places found from l members move behind their group, into a new one with the longer word.
    """
    n = len(ranks)
    last = max(ranks, default=-1)
    members: list[list[int]] = [[] for _ in range(last + 1)]
    for i, rank in enumerate(ranks):
        members[rank].append(i)
    group = list(ranks)
    size = [1] * (last + 1)
    before = list(range(-1, last))
    after = [*range(1, last + 1), -1]
    # Place of the nearest suffix that is not taken yet, at or left of a place; shifted by one.
    left = list(range(n + 1))
    lengths = [0] * n
    g = last
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        length = size[g]
        for i in own:
            lengths[i] = length
            left[i + 1] = i
        found: dict[int, int] = {}
        for i in own:
            at = i
            while left[at] != at:
                left[at] = at = left[left[at]]
            left[i + 1] = at
            if at:
                found[at - 1] = found.get(at - 1, 0) + 1
        if found:
            parts: dict[tuple[int, int], list[int]] = {}
            for i, times in found.items():
                parts.setdefault((times, group[i]), []).append(i)
            for times, old in sorted(parts, reverse=True):
                new = len(members)
                moved = parts[times, old]
                members.append(moved)
                for i in moved:
                    group[i] = new
                size.append(size[old] + times * length)
                following = after[old]
                before.append(old)
                after.append(following)
                after[old] = new
                before[following] = new
        g = before[g]
    return lengths


class Extensions:
    """Longest common extensions of pairs of places, by prefix hashes."""

    def __init__(self, words: np.ndarray, seed: int = 12):
        n = len(words)
        drawn = np.random.default_rng(seed).integers(0, 2**64, int(words.max(initial=0)) + 1, np.uint64)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, FACTOR, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(drawn[words] * self.powers[:-1])]
        self.n = n

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from a on and from b on (a <= b) agree over ``size``."""
        left = (self.sums[a + size] - self.sums[a]) * self.powers[b - a]
        return left == self.sums[b + size] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from a and b on, or before them with ``back``."""
        low = np.zeros(len(a), np.int64)
        high = a.copy() if back else self.n - b
        while (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            same = self.equal(a - shift, b - shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def extend(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The run of the root at ``at``, by comparing words."""
    same = words[:-period] == words[period:]
    before = np.flatnonzero(~same[:at])
    behind = np.flatnonzero(~same[at:])
    return int(before[-1]) + 1 if len(before) else 0, (at + int(behind[0]) if len(behind) else len(same)) + period


def runs_of(words: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """Rows (start, end, period) of the runs in a sequence of word numbers, in order."""
    n = len(words)
    if not n:
        return np.zeros((0, 3), np.int64)
    top = int(words.max())
    extensions, found = Extensions(words), []
    for ranks in (words, top - words):
        period = np.array(lyndon_array(ranks.tolist()), np.int64)
        at = np.arange(n)
        if copies >= 3:
            # A root within the first period and its copy both lie in the run.
            at = np.flatnonzero(at + 2 * period <= n)
            at = at[extensions.equal(at, at + period[at], period[at])]
        found.append(np.stack([at, period[at]], axis=1))
    roots = np.concatenate(found)
    if copies >= 3:
        # Of roots one period apart, each with its copy behind it, the first is enough.
        roots = roots[np.lexsort((roots[:, 0], roots[:, 1]))]
        follows = (roots[1:, 1] == roots[:-1, 1]) & (roots[1:, 0] == roots[:-1, 0] + roots[1:, 1])
        roots = roots[~np.r_[False, follows]]
    at, period = roots.T
    start = at - extensions.reach(at, at + period, back=True)
    end = at + period + extensions.reach(at, at + period)
    long = end - start >= np.maximum(least, copies * period)
    at, runs = at[long], np.stack([start, end, period], axis=1)[long]
    runs, of_root = np.unique(runs, axis=0, return_inverse=True)
    kept = set()
    for i, (s, e, p) in enumerate(runs.tolist()):
        if (words[s : e - p] == words[s + p : e]).all():
            kept.add((s, p, e))
            continue
        for root in at[of_root.ravel() == i].tolist():
            s, e = extend(words, root, p)
            if e - s >= max(least, copies * p):
                kept.add((s, p, e))
    return np.array([(s, e, p) for s, p, e in sorted(kept)], np.int64).reshape(-1, 3)


def stretches(words: np.ndarray, of_text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (start, end) of the places that windows occurring again in the same text cover."""
    n = len(words)
    if n <= window:
        return np.zeros((0, 2), np.int64)
    sums = Extensions(words)
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - window, INVERSE, np.uint64)])
    starts = np.flatnonzero(of_text[: n - window + 1] == of_text[window - 1 :])
    keys = (sums.sums[starts + window] - sums.sums[starts]) * back[starts] + of_text[starts].astype(np.uint64) * np.uint64(INVERSE)
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    again = starts[order[np.r_[False, equal] | np.r_[equal, False]]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    first = covered & np.r_[True, ~covered[:-1] | (of_text[1:] != of_text[:-1])]
    ends = covered & np.r_[~covered[1:] | (of_text[1:] != of_text[:-1]), True]
    return np.stack([np.flatnonzero(first), np.flatnonzero(ends) + 1], axis=1)


def runs_of_texts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, end, period) of every text, one text after the other, and how many each has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros(len(texts), np.int64)
    all_words = np.array([w for words in texts for w in words], object)
    if not len(all_words):
        return np.zeros((0, 3), np.int64), counts
    numbers = pd.factorize(all_words)[0]
    of_text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    parts = stretches(numbers, of_text)
    parts = parts[parts[:, 1] - parts[:, 0] >= LEAST]
    if not len(parts):
        return np.zeros((0, 3), np.int64), counts
    lengths = parts[:, 1] - parts[:, 0]
    # Stretches one after the other, each with a number of its own behind it.
    total = int((lengths + 1).sum())
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    behind = np.zeros(total, bool)
    behind[begins + lengths] = True
    places = np.arange(total) - np.repeat(begins - parts[:, 0], lengths + 1)
    joined = np.zeros(total, np.int64)
    joined[~behind] = numbers[places[~behind]]
    joined[behind] = numbers.max() + 1 + np.arange(len(parts))
    runs = runs_of(pd.factorize(joined)[0])
    of_part = np.searchsorted(begins, runs[:, 0], "right") - 1
    text = of_text[parts[of_part, 0]]
    shift = begins[of_part] - parts[of_part, 0] + first[text]
    runs = np.stack([runs[:, 0] - shift, runs[:, 1] - shift, runs[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    np.add.at(counts, text, 1)
    return runs[order], counts


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run covers after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
    return b" ".join(words)


def find_runs(
    docs: DataFrame, text_col: str = "text", runs: str = "runs", n_words: str = "n_words", collapsed: str = "collapsed"
) -> DataFrame:
    """``docs`` with its runs (start, length, period) in order, number of words, and collapsed text."""
    (body,) = fresh(docs, "body")
    clash = {c.lower() for c in docs.columns} & {runs.lower(), n_words.lower(), collapsed.lower()}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}; name others")
    kind = "array<struct<start:long,length:long,period:long>>"
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(body)
            texts = batch.column(at)
            kept = [i for i in range(batch.num_columns) if i != at]
            sizes = pc.binary_length(texts).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                words = [t.split() for t in texts.slice(a, b - a).to_pylist()]
                rows, counts = runs_of_texts(words)
                ends = np.cumsum(counts)
                short = [collapse(w, rows[e - c : e]).decode() for w, e, c in zip(words, ends, counts, strict=True)]
                parts = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(fields))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in kept], lists, pa.array([len(w) for w in words], pa.int64()), pa.array(short, pa.string())],
                    [*[batch.schema.names[i] for i in kept], runs, n_words, collapsed],
                )

    keyed = docs.withColumn(body, whole(F.col(text_col)).cast("binary"))
    added = StructType.fromDDL(f"`{runs}` {kind}, `{n_words}` long, `{collapsed}` string")
    return keyed.mapInArrow(compute, StructType([*docs.schema.fields, *added.fields]))
