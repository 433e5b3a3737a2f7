"""Exact repeated passages through prefix-partitioned suffix trees.

A suffix is a document from some word on; a passage of 13 words repeats when two suffixes
share their first 13 words, that is, when they hang below one internal node of depth 13.
Suffixes are split into groups by a prefix of variable length: the one that ends with the
smallest three-word hash among the first 13 words. Equal passages have equal prefixes, so a
node never spans groups. Neighbouring suffixes mostly have the same smallest hash, so they
travel as one stretch of words instead of 13 words each. The number of groups follows the
total length of all texts, so that a group fits in memory, and a group is treated alone.

In a group the suffixes are sorted by the words they start with, by prefix doubling: ranks of
one, two, four and eight words give those of 13. Suffixes of one rank have 13 words in common
and are the leaves of one deep node, side by side. A window that a smaller id also starts is
a repeat; joined to runs, these are the maximal repeats of the larger documents.

A task first does the same among its own documents. Windows repeated there are settled at
once and only those of the smallest document go on, so that a passage shared by a third of
all documents reaches its group at most once per task batch.

Null text has no words. Null ids are ordered first. Rows that repeat an id are the same
document when their texts agree, otherwise each is judged by itself; neither counts as a
smaller id for the other. A text of any length is one document and never cut. An empty
table gives an empty result. Other columns are kept where documents are returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import fresh, same, text_key, whole

WINDOW = 13
ANCHOR = 3
# Characters of text that a task settles at once, and that a group receives.
BATCH_CHARS = 8_000_000
GROUP_CHARS = 6_000_000
NO_ID = -(2**63)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def numbered(words: list[bytes], seen: defaultdict) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def ranks_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rank of each pair of ranks (first, second) among all pairs, from 0; equal pairs share one."""
    keys = first * (np.int64(second.max(initial=0)) + 1) + second
    order = np.argsort(keys)
    new = np.zeros(len(keys), np.int64)
    new[order[1:]] = np.cumsum(np.diff(keys[order]) != 0)
    return new


def prefix_ranks(tokens: np.ndarray, window: int) -> np.ndarray:
    """Rank of the ``window`` words from each place on, by doubling the length that is ranked."""
    ranks, size = tokens, 1
    while size < window:
        # The last step overlaps where the length is no power of two.
        gap = min(size, window - size)
        ranks = ranks_of(ranks[:-gap], ranks[gap:])
        size += gap
    return ranks


def repeats_in(tokens: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which windows (word numbers from place ``at``) also start in a document of smaller order.

    ``doc`` holds the order of each window's document. The windows are the leaves of the suffix
    tree in order; those below one node of depth ``window`` have a rank in common.
    """
    repeated = np.zeros(len(at), bool)
    if not len(at):
        return repeated
    rank = prefix_ranks(tokens, window)[at]
    order = np.lexsort((doc, rank))
    head = np.r_[True, rank[order[1:]] != rank[order[:-1]]]
    first = doc[order[head]]
    node = np.cumsum(head) - 1
    repeated[order] = doc[order] > first[node]
    return repeated


def runs_of(flags: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches of set flags within which all of ``breaks`` stay equal."""
    if not len(flags):
        return np.zeros(0, int), np.zeros(0, int)
    new = np.r_[True, ~flags[:-1]]
    for values in breaks:
        new[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(new & flags)
    label = np.cumsum(new & flags)[flags] - 1
    return starts, np.bincount(label, minlength=len(starts))


def pack(docs, keys, starts, sizes, text: bytes = b"") -> bytes:
    """Rows ascend by document within a task batch, so ids travel as differences, byte by byte place."""
    meta = np.stack([np.diff(np.asarray(docs, np.int64), prepend=np.int64(0)), keys, starts, sizes])
    places = np.ascontiguousarray(meta.astype("<i8").view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1))
    return len(docs).to_bytes(8, "little") + zstandard.compress(places.tobytes() + text, 3)


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.decompress(blob[8:])
    places = np.frombuffer(raw[: 32 * n], np.uint8).reshape(4, 8, n).transpose(0, 2, 1)
    meta = np.ascontiguousarray(places).view("<i8").reshape(4, n)
    return np.concatenate([np.cumsum(meta[:1], axis=1), meta[1:]]), raw[32 * n :]


def stretches(ids: list[int], keys: list[int], texts: list[bytes], groups: int, window: int) -> Iterator[tuple]:
    """(group, settled, blob) rows of one batch: runs settled here, and stretches for the groups."""
    seen: defaultdict = defaultdict(count().__next__)
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not sizes.sum():
        return
    tokens = np.concatenate([numbered(w, seen) for w in words])
    flat = [w for doc in words for w in doc]
    del words
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    # Order of the documents' ids; equal ids share a rank.
    _, rank = np.unique(np.array(ids, np.int64), return_inverse=True)
    at = np.flatnonzero(np.arange(len(tokens)) + window <= ends)
    repeated = repeats_in(tokens, at, rank[owner[at]], window)
    settled = np.zeros(len(tokens), bool)
    settled[at[repeated]] = True
    starts, lengths = runs_of(settled, owner)
    doc_ids, doc_keys = np.array(ids, np.int64), np.array(keys, np.int64)
    if len(starts):
        own = owner[starts]
        yield int(starts[0] + len(tokens)) % groups, True, pack(doc_ids[own], doc_keys[own], starts - begin[starts], lengths)
    going = np.zeros(len(tokens), bool)
    going[at[~repeated]] = True
    if not going.any():
        return
    # Hashes of words that all tasks agree on choose the prefix that names the group.
    word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))[tokens]
    width = len(tokens) - ANCHOR + 1
    anchor = np.zeros(width, np.uint64)
    for i in range(ANCHOR):
        anchor = anchor * np.uint64(0x100000001B3) + word_hash[i : width + i]
    least = np.zeros(len(tokens), np.uint64)
    least[: len(tokens) - window + 1] = sliding_min(mixed(anchor), window - ANCHOR + 1)
    starts, lengths = runs_of(going, owner, least)
    # The smallest of many hashes is small itself, so it is mixed again to choose the group.
    group = (mixed(least[starts]) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1, len(order)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        chosen = order[lo:hi]
        s, n = starts[chosen], lengths[chosen] + window - 1
        text = b" ".join([b" ".join(flat[a:b]) for a, b in zip(s.tolist(), (s + n).tolist(), strict=True)])
        own = owner[s]
        yield int(group[order[lo]]), False, pack(doc_ids[own], doc_keys[own], s - begin[s], n, text)


def group_repeats(blobs: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Runs (id, key, first window, windows) of one group that repeat a smaller document."""
    metas, seen, parts = [], defaultdict(count().__next__), []
    for blob in blobs:
        meta, text = unpack(blob)
        metas.append(meta)
        parts.append(numbered(text.split(), seen))
    docs, keys, starts, sizes = np.concatenate(metas, axis=1)
    tokens = np.concatenate(parts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(np.arange(len(tokens)) + window <= np.repeat(np.cumsum(sizes), sizes))
    repeated = np.zeros(len(tokens), bool)
    repeated[at] = repeats_in(tokens, at, docs[owner[at]], window)
    s, n = runs_of(repeated, owner)
    return docs[owner[s]], keys[owner[s]], starts[owner[s]] + s - first[s], n


def short_key(text_col: str) -> Column:
    """32 bits of the text key: enough to tell a few texts of one id apart, and half to move."""
    return text_key(F.col(text_col)).bitwiseAND(F.lit(2**32 - 1).cast("long"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id (smallest long for null), text_key, start, length: word runs to remove; they may overlap."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        short_key(text_col).alias("text_key"),
        whole(F.col(text_col)).cast("binary").alias("text"),
    )
    total = docs.agg(F.sum(F.octet_length(whole(F.col(text_col))))).first()[0] or 0
    # A stretch moves 13 words and one for every further window, about three times the text.
    groups = max(1, 3 * total // GROUP_CHARS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, keys, texts, size = [], [], [], 0

        def done():
            out = list(stretches(ids, keys, texts, groups, window))
            return pd.DataFrame(out, columns=["group", "settled", "blob"])

        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                ids.append(doc_id)
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield done()
                    ids, keys, texts, size = [], [], [], 0
        yield done()

    def runs(docs, keys, starts, sizes) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": docs, "text_key": keys, "start": starts, "length": sizes + window - 1})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            for group, settled, blob in zip(batch["group"], batch["settled"], batch["blob"], strict=True):
                if settled:
                    yield runs(*unpack(blob)[0])
                    continue
                if group != current and held:
                    yield runs(*group_repeats(held, window))
                    held = []
                current = group
                held.append(blob)
        if held:
            yield runs(*group_repeats(held, window))

    return (
        rows.mapInPandas(cut, "group long, settled boolean, blob binary")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInPandas(search, "doc_id long, text_key long, start long, length long")
    )


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flags of the words inside any of the runs."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:n]) > 0


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    n_words: str = "n_words",
    n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with, as text, the words that stay, joined by one space, and two counts under new names.

    A text without words becomes empty; a null text stays null.
    """
    runs = find_repeats(docs, id_col, text_col, window)
    packed = F.shiftleft(F.col("start"), 31).bitwiseOR(F.col("length"))
    own_id, key, cut_id, cut_key, gone, kept_col = fresh(docs, "own_id", "key", "cut_id", "cut_key", "gone", "kept")
    cut = (
        runs.groupBy("doc_id", "text_key")
        .agg(F.collect_list(packed).alias(gone))
        .select(F.col("doc_id").alias(cut_id), F.col("text_key").alias(cut_key), gone)
    )
    keyed = docs.withColumns({own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), key: short_key(text_col)})
    joined = keyed.join(cut, same(keyed, cut, {own_id: cut_id, key: cut_key}), "left")

    @F.pandas_udf("struct<text string, n_words long, n_removed long>")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, packed in zip(texts, runs, strict=True):
            words = (text or "").encode().split()
            if packed is None or not len(packed):
                stays = words
            else:
                packed = np.asarray(packed, np.int64)
                gone = covered(len(words), packed >> 31, packed & (2**31 - 1))
                stays = [words[i] for i in np.flatnonzero(~gone)]
            out.append((None if text is None else b" ".join(stays).decode(), len(words), len(words) - len(stays)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    result = joined.withColumn(kept_col, kept(keyed[text_col], F.col(gone)))
    found = F.col(kept_col)
    return result.select(
        *[found["text"].alias(c) if c == text_col else keyed[c] for c in docs.columns],
        found["n_words"].alias(n_words),
        found["n_removed"].alias(n_removed),
    )
