"""Near duplicates by SimHash, found through deletion-variant signatures.

Two fingerprints of 64 bits link when at most three bits differ. Cut into two segments, one
segment differs by at most one bit. Every segment is indexed under its 32 one-wildcard
variants (the segment without one bit), so each linked pair shares at least one of the 64
keys; keys are joined by equality and the whole fingerprints verified.

Only distinct fingerprints are indexed: copies meet in one row first. Rows sorted by key
stream through a task; of the fingerprints under one key only a spanning forest of their
links goes on, never all pairs, and a key with very many fingerprints is searched by the
bytes of its other segment. Components are then found by graph.components.

Null text has no words. A text without words has fingerprint 0 and links like any other; one
with fewer words than a shingle is one shingle. A null id is never chosen as component id
unless all ids of the component are null. Repeated rows give repeated results. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import fresh, whole
from riskgraph.llm.graph import components
from riskgraph.session import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENT = 32
# Shingles whose bits are unpacked at once, and fingerprints of a key compared directly.
UNPACKED = 200_000
COMPARED = 4096
# Bytes of text whose shingle hashes are held at once.
BATCH_CHARS = 2_000_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    rows = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(row, SEED) for row in rows), np.uint64, len(words) - shingle + 1)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints (int64) of consecutive groups of hashes."""
    counts = np.zeros((len(sizes), 64), np.int64)
    filled = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(filled):
        # Whole groups up to UNPACKED hashes; a longer group is folded in pieces.
        last = max(at + 1, int(np.searchsorted(starts[filled + 1], starts[filled[at]] + UNPACKED, "right")))
        group = filled[at:last]
        lo, hi = starts[group[0]], starts[group[-1] + 1]
        for piece in range(lo, hi, UNPACKED if last == at + 1 else hi - lo):
            end = min(hi, piece + UNPACKED) if last == at + 1 else hi
            bits = np.unpackbits(hashes[piece:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.maximum(starts[group] - piece, 0) if last > at + 1 else [0]
            counts[group] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        at = last
    ones = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<i8").ravel() if len(sizes) else np.zeros(0, np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["text"].map(len).cumsum() // BATCH_CHARS, sort=False):
                groups = [shingle_hashes(text) for text in part["text"]]
                sizes = np.fromiter(map(len, groups), np.int64, len(groups))
                bits = majority_bits(np.concatenate(groups), sizes)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "fingerprint": bits})

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInPandas(compute, f"doc_id {kind}, fingerprint long")


def variant_keys(fingerprint: Column) -> Column:
    """64 longs: number of the wildcard bit in the high half, the segment without it in the low half."""
    keys = []
    for bit in range(64):
        segment = F.shiftrightunsigned(fingerprint, SEGMENT) if bit >= SEGMENT else fingerprint
        mask = (2**SEGMENT - 1) & ~(1 << bit % SEGMENT)
        keys.append(segment.bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit(bit << SEGMENT).cast("long")))
    return F.array(*keys)


def forest(values: np.ndarray, other_shift: int | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64)."""
    if len(values) > COMPARED and other_shift is not None:
        # At most three bits differ in the other segment, so one of its four bytes is equal.
        edges = []
        for byte in range(4):
            part = (values >> np.uint64(other_shift + 8 * byte)) & np.uint64(255)
            for value in np.unique(part):
                edges += forest(values[part == value])
        return edges
    edges = []
    rest = values
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= MAX_BITS
            if near.any():
                found = rest[near]
                edges += [(node, f) for f in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


def link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges under each key of rows sorted by key; a key may go on in the next batch."""
    held_keys = np.zeros(0, np.int64)
    held = np.zeros(0, np.uint64)

    def linked(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(keys)].astype(int)
        pairs = starts[ends - starts == 2]
        near = np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= MAX_BITS
        a, b = [values[pairs[near]]], [values[pairs[near] + 1]]
        bit = keys >> SEGMENT
        wild = (values >> bit.astype(np.uint64)) & np.uint64(1)
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            # Fingerprints with an equal segment meet under every wildcard; one is enough.
            if bit[s] % SEGMENT and wild[s:e].min() == wild[s:e].max():
                continue
            edges = forest(values[s:e], 0 if bit[s] >= SEGMENT else SEGMENT)
            a.append(np.fromiter((x for x, _ in edges), np.uint64, len(edges)))
            b.append(np.fromiter((y for _, y in edges), np.uint64, len(edges)))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if sum(map(len, a)) else np.zeros((0, 2), np.uint64)
        return pd.DataFrame({"a": both[:, 0].astype(np.int64), "b": both[:, 1].astype(np.int64)})

    for batch in batches:
        keys = np.concatenate([held_keys, batch["key"].to_numpy(np.int64)])
        values = np.concatenate([held, batch["fingerprint"].to_numpy(np.int64).view(np.uint64)])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        held_keys, held = keys[last:], values[last:]
        yield linked(keys[:last], values[:last])
    yield linked(held_keys, held)


def links(distinct: DataFrame) -> DataFrame:
    """a, b: edges between distinct fingerprints that connect all that are linked."""
    keyed = distinct.select(F.explode(variant_keys(F.col("fingerprint"))).alias("key"), "fingerprint")
    return (
        keyed.repartition("key")
        .sortWithinPartitions("key", "fingerprint")
        .mapInPandas(link_runs, "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fingerprint")))
    placed = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = materialize(
        placed.join(smallest, "root").select(F.col("fingerprint").alias("class"), "component_id"), "component-ids"
    )
    return rows.join(of_class, F.col("fingerprint") == F.col("class"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows that repeat this id all stay; so do rows without an id.
    """
    (name,) = fresh(docs, "kept")
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    with_id = docs.join(kept, docs[id_col] == kept[name], "left_semi")
    return with_id.union(docs.filter(docs[id_col].isNull()))
