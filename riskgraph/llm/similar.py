"""Near duplicates by SimHash, verified by the Jaccard similarity of five-word shingles, 0.8 or more.

Documents whose fingerprints link under simhash are candidates. A SimHash of 64 bits alone is
too coarse: at similarity 0.8 about ten bits differ, and segments short enough to survive that
are shared by unrelated documents. So more candidates come from MinHash:
25 bands of five minima, of which a pair of similarity 0.8 shares at least one with a
probability of 0.99995. Every link is then verified on the whole shingle sets.

Documents with equal shingle sets meet in one row first. In a first pass each member of a
band, and of a class of equal fingerprints, is compared with its smallest node. Components of the verified links leave few
bands whose members lie apart. Only the documents of those go through an exact join: their
shingles are ordered by rarity, and two sets that are similar share one of the rarest fifth
of each, at places that leave enough shingles behind it in both. Near copies that differ in
more than that have shingles of their own in front and never meet. Under a shingle, only the
links that tie components together are tried, then verified; a last round tries what still
lies apart. So no round makes all pairs of a group of near copies.

Words are those of simhash. A text of fewer words than a shingle is one shingle; texts
without words are copies of each other. Rows without an id all stay and link nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import fresh, whole
from riskgraph.llm.graph import components
from riskgraph.llm.simhash import BATCH_CHARS, links, majority_bits, shingle_hashes
from riskgraph.session import materialize

SHINGLE = 5
BANDS = 25
ROWS = 5
# Odd factors of the permutations (fixed values).
FACTORS = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
# Pairs that go on in one batch.
PAIRS = 100_000


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(shingles: np.ndarray) -> int:
    """One number (int64) for equal shingle sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """Keys (int64) of the bands of every set; none for an empty set."""
    filled = [s for s in sets if len(s)]
    if not filled:
        return [[] for _ in sets]
    sizes = np.fromiter(map(len, filled), np.int64, len(filled))
    hashes, starts = np.concatenate(filled), np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(hashes * factor, starts) for factor in FACTORS], axis=1)
    rows = iter([
        [xxhash.xxh3_64_intdigest(row[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]
        for row in least
    ])
    return [next(rows) if len(s) else [] for s in sets]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node, size of the shingle set, keys of its bands, fingerprint of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["text"].map(len).cumsum() // BATCH_CHARS, sort=False):
                sets = [shingle_set(text) for text in part["text"]]
                hashes = [shingle_hashes(text) for text in part["text"]]
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "node": [node_of(s) for s in sets],
                        "size": [len(s) for s in sets],
                        "keys": band_keys(sets),
                        "fingerprint": majority_bits(np.concatenate(hashes), sizes),
                    }
                )

    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text")
    )
    return rows.mapInPandas(compute, f"doc_id {kind}, node long, size long, keys array<long>, fingerprint long")


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches sorted by key, where it has two or more."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and batch["key"].iloc[-1] == held[0]["key"].iloc[0]:
            held.append(batch)
            continue
        whole_batch = pd.concat([*held, batch], ignore_index=True)
        keys = whole_batch["key"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                yield whole_batch.iloc[a:b]
        held = [whole_batch.iloc[cuts[-1] :]]
    if held:
        last = pd.concat(held, ignore_index=True)
        if len(last) > 1:
            yield last


def in_batches(pairs: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Arrays of two columns as frames of about PAIRS rows."""
    kept, n = [], 0
    for pair in pairs:
        kept.append(pair)
        n += len(pair)
        if n >= PAIRS:
            yield pd.DataFrame(np.concatenate(kept), columns=["a", "b"])
            kept, n = [], 0
    if n:
        yield pd.DataFrame(np.concatenate(kept), columns=["a", "b"])


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every other node under a key with the key's smallest node."""

    def pairs() -> Iterator[np.ndarray]:
        for run in runs(batches):
            nodes = run["node"].to_numpy()
            yield np.stack([np.full(len(nodes) - 1, nodes[0]), nodes[1:]], axis=1)

    yield from in_batches(pairs())


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each node with the smallest one of its fingerprint, and the smallest ones of linked fingerprints."""
    classes = materialize(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "classes")
    equal = nodes.join(classes, "fingerprint").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = (classes.select(F.col("fingerprint").alias(c), F.col("first").alias(f"of_{c}")) for c in ("a", "b"))
    linked = links(classes.select("fingerprint")).join(one, "a").join(other, "b")
    return equal.union(linked.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def may_be_alike(n: np.ndarray, i: np.ndarray, m: int, j: int) -> np.ndarray:
    """Whether sets of n and m shingles that share the ones at places i and j, and none before, can reach 0.8."""
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def meet(every: bool):
    """Pairs under a shingle whose roots differ: ``every`` one that may be alike, or enough to tie their roots."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs() -> Iterator[np.ndarray]:
            for run in runs(batches):
                nodes, n, i = (run[c].to_numpy() for c in ("node", "size", "at"))
                # In every pair the smaller set has its shingle within its first ninth.
                if not (9 * i <= n).any():
                    continue
                roots = pd.factorize(run["root"])[0]
                for a in range(len(nodes) - 1):
                    rest = slice(a + 1, len(nodes))
                    near = (roots[rest] != roots[a]) & may_be_alike(n[rest], i[rest], n[a], i[a])
                    if not near.any():
                        continue
                    found = np.flatnonzero(near) + a + 1
                    if not every:
                        tied, first = np.unique(roots[found], return_index=True)
                        found = found[first]
                    yield np.stack([np.full(len(found), nodes[a]), nodes[found]], axis=1)
                    if not every:
                        roots[np.isin(roots, tied)] = roots[a]
                        if (roots == roots[0]).all():
                            break

        yield from in_batches(pairs())

    return compute


def alike(a: bytes, b: bytes) -> bool:
    """Whether two sorted shingle sets have a Jaccard similarity of 0.8 or more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n, m = len(x), len(y)
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (n + m - both)


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [alike(a, b) for a, b in zip(batch["set_a"], batch["set_b"], strict=True)]
        yield batch.loc[near, ["a", "b"]]


def apart(keyed: DataFrame) -> DataFrame:
    """of_node: members of keys (key, node, root) that hold more than one root."""
    mixed = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return keyed.join(mixed.select("key"), "key", "left_semi").select(F.col("node").alias("of_node")).distinct()


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """key, node, size, at: the rarest fifth of the shingles of each set (of_node, shingles), by rarity.

    A shingle's place counts from the rarest; the key is the shingle and a band of set sizes,
    of which each set stands in its own and the next, as similar sets lie at most one apart.
    """

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["shingles"].map(len).cumsum() // BATCH_CHARS
            for _, part in batch.groupby(held, sort=False):
                sizes = part["shingles"].map(len).to_numpy() // 8
                found = np.frombuffer(b"".join(part["shingles"]), np.int64)
                nodes = np.repeat(part["of_node"].to_numpy(), sizes)
                yield pd.DataFrame({"node": nodes, "size": np.repeat(sizes, sizes), "shingle": found})

    single = sets.mapInPandas(compute, "node long, size long, shingle long")
    times = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    # A shingle of one set leads to nobody, but its place counts.
    ordered = (
        single.join(times, "shingle").groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("all"))
    )
    prefix = F.slice("all", 1, (F.floor(F.col("size") / 5) + 1).cast("int"))
    placed = ordered.select("node", "size", F.posexplode(prefix).alias("at", "s")).filter("s.times > 1")
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1.25) - 1e-9).cast("long")
    bands = F.explode(F.array(band, band + 1)).alias("band")
    return placed.select(F.col("s.shingle").alias("shingle"), "node", "size", "at", bands).select(
        F.xxhash64("shingle", "band").alias("key"), "node", "size", F.col("at").cast("long").alias("at")
    )


def shingle_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """of_node, shingles (sorted hashes as bytes) of the ``chosen`` documents (least, node)."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["text"].map(len).cumsum() // BATCH_CHARS, sort=False):
                sets = [shingle_set(text) for text in part["text"]]
                # Another text under the same id is not the one that is meant.
                mine = [node_of(s) == node for s, node in zip(sets, part["node"], strict=True)]
                out = pd.DataFrame({"of_node": part["node"], "shingles": [s.tobytes() for s in sets]})
                yield out.loc[mine]

    texts = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    rows = texts.join(chosen, F.col("doc_id") == F.col("least")).select("node", "text")
    return rows.mapInPandas(compute, "of_node long, shingles binary").dropDuplicates(["of_node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose sets are alike."""
    b = sets.select(F.col("of_node").alias("nb"), F.col("shingles").alias("set_b"))
    a = sets.select(F.col("of_node").alias("na"), F.col("shingles").alias("set_a"))
    both = pairs.join(b, F.col("b") == F.col("nb")).join(a, F.col("a") == F.col("na"))
    return both.select("a", "b", "set_a", "set_b").mapInPandas(verify, "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row with an id: the smallest id reachable over links."""
    rows = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("fingerprint").alias("fingerprint"))
    nodes = materialize(nodes, "nodes")

    def under_keys(of: DataFrame, *more: str) -> DataFrame:
        keyed = of.select(F.explode("keys").alias("key"), "node", *more)
        return keyed.repartition("key").sortWithinPartitions("key", "node")

    banded = under_keys(nodes).mapInPandas(stars, "a long, b long")
    first = materialize(banded.union(simhash_pairs(nodes)).distinct(), "pairs")
    ends = first.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    chosen = materialize(nodes.join(ends, F.col("node") == F.col("end"), "left_semi"), "chosen")
    sets = materialize(shingle_sets(docs, chosen.select("least", "node"), id_col, text_col), "shingle-sets")
    near = materialize(verified(first, sets), "links")
    roots = components(near).withColumnRenamed("node", "of_node")
    rooted = chosen.join(roots, F.col("node") == F.col("of_node"), "left").withColumn("root", F.coalesce("root", "node"))
    loose = apart(rooted.select(F.explode("keys").alias("key"), "node", "root"))
    prefixes = materialize(rare_prefixes(sets.join(loose, "of_node", "left_semi")), "prefixes")

    def tried(links: DataFrame, every: bool) -> DataFrame:
        now = components(links).select(F.col("node").alias("of_node"), "root")
        keyed = prefixes.join(now, F.col("node") == F.col("of_node"), "left").select(
            "key", "node", "size", "at", F.coalesce("root", "node").alias("root")
        )
        sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "at", "node")
        return sorted_rows.mapInPandas(meet(every), "a long, b long").distinct()

    ties = materialize(tried(near, False), "pairs")
    near = materialize(near.union(verified(ties, sets)), "links")
    last = materialize(tried(near, True).join(ties, ["a", "b"], "left_anti"), "pairs")
    last = materialize(verified(last, sets), "links")
    roots = components(near.union(last)).withColumnRenamed("node", "of_node")
    placed = nodes.join(roots, F.col("node") == F.col("of_node"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.select("node", "root").join(smallest, "root").select(F.col("node").alias("of_node"), "component_id")
    return rows.join(of_node, F.col("node") == F.col("of_node"), "left").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows that repeat this id all stay; so do rows without an id.
    """
    (name,) = fresh(docs, "kept")
    found = similar(docs.select(id_col, text_col), id_col, text_col)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    with_id = docs.join(kept, docs[id_col] == kept[name], "left_semi")
    return with_id.union(docs.filter(docs[id_col].isNull()))
