"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Random indexing gives every word a sparse random index vector and sums, over all documents,
the index vectors of the words around each of its occurrences (itself included) to its word
vector. Words share a fixed number of hashed places, so that the table has one size whatever
the vocabulary; tasks add up their part, parts are added by table slice. A document is the
mean of its words' vectors. A two-layer network in numpy is fitted on labelled documents,
and one temperature, found on rows kept out of the fit, calibrates its probabilities.

The only bound: the fit takes at most FIT_ROWS labelled documents, about as many as that with
the smallest hash of their id. Word vectors cover all documents, and all documents are scored.

Null text counts as empty; an empty text has the zero vector and gets a score like any other.
Null ids are scored, but never labelled. Rows that repeat an id are scored each. Labels with
a null id or quality are left out; labels that differ for one id all count. With no usable
labels, or only one class, every score is the mean label (0.5 without any). An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import fresh, whole
from riskgraph.session import materialize

PLACES = 16_384
DIMENSIONS = 32
NONZERO = 6
REACH = 2
SLICE = 512
FIT_ROWS = 20_000
HIDDEN = 32
KEEP_FROM = 0.7
# Words and their vectors take up to a hundred times the bytes of their text while a piece is worked on.
BATCH_CHARS = 500_000
KNOWN_WORDS = 150_000
# Runs of letters, of digits and of other signs are words of their own.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")


class Places(dict):
    """Word to hashed place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = xxhash.xxh32_intdigest(word) % PLACES
        return place


def index_vectors() -> np.ndarray:
    """Sparse vectors of -1, 0 and 1 by place, the same in every task."""
    rng = np.random.Generator(np.random.PCG64(11))
    table = np.zeros((PLACES, DIMENSIONS), np.int8)
    for row in table:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return table


def parts_of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in pieces of about BATCH_CHARS bytes, rows whole."""
    for _, part in batch.groupby(batch["text"].map(len).cumsum() // BATCH_CHARS, sort=False):
        yield part


def placed(texts: list[bytes], places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words, and the number of words of each text."""
    if len(places) > KNOWN_WORDS:
        places.clear()
    words = [WORD.findall(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((p for w in words for p in map(places.__getitem__, w)), np.uint16, int(sizes.sum()))
    return flat, sizes


def add_contexts(sums: np.ndarray, texts: list[bytes], places: Places, table: np.ndarray) -> None:
    """Add to the ``sums`` by place the index vectors around every word of the texts."""
    flat, sizes = placed(texts, places)
    if not len(flat):
        return
    own = table[flat]
    around = own.copy()
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for shift in range(1, REACH + 1):
        within = (doc[shift:] == doc[:-shift]).astype(np.int8)[:, None]
        around[shift:] += own[:-shift] * within
        around[:-shift] += own[shift:] * within
    order = np.argsort(flat, kind="stable")
    sorted_places = flat[order]
    starts = np.flatnonzero(np.r_[True, sorted_places[1:] != sorted_places[:-1]])
    sums[sorted_places[starts]] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors by place, from all documents (column text, binary)."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, places = index_vectors(), Places()
        sums = np.zeros((PLACES, DIMENSIONS), np.int64)
        for batch in batches:
            for part in parts_of(batch):
                add_contexts(sums, list(part["text"]), places, table)
        yield pd.DataFrame(
            {"slice": range(PLACES // SLICE), "sums": [sums[i : i + SLICE].tobytes() for i in range(0, PLACES, SLICE)]}
        )

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, sums in zip(batch["slice"], batch["sums"], strict=True):
                part = np.frombuffer(sums, np.int64)
                total[number] = total[number] + part if number in total else part
        yield pd.DataFrame({"slice": list(total), "sums": [x.tobytes() for x in total.values()]})

    merged = (
        texts.mapInPandas(gather, "slice int, sums binary")
        .repartition("slice")
        .mapInPandas(add, "slice int, sums binary")
        .collect()  # the table of word vectors: PLACES x DIMENSIONS numbers, whatever the input
    )
    table = np.zeros((PLACES, DIMENSIONS))
    for row in merged:
        table[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.sums, np.int64).reshape(-1, DIMENSIONS)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, vector: the mean word vector of every row, as bytes of 32-bit floats."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places()
        for batch in batches:
            for part in parts_of(batch):
                flat, sizes = placed(list(part["text"]), places)
                means = np.zeros((len(sizes), DIMENSIONS), np.float32)
                filled = sizes > 0
                if filled.any():
                    starts = (np.cumsum(sizes) - sizes)[filled]
                    sums = np.add.reduceat(shared.value[flat], starts, axis=0, dtype=np.float32)
                    means[filled] = sums / sizes[filled, None]
                yield pd.DataFrame({"doc_id": part["doc_id"], "vector": [m.tobytes() for m in means]})

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInPandas(pool, f"doc_id {kind}, vector binary")


class Network:
    """Two layers and a temperature; ``score`` is the probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, rate: float = 0.01) -> None:
        self.prior = float(y.mean()) if len(y) else 0.5
        self.usable = 0 < self.prior < 1 and len(y) >= 10
        if not self.usable:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        order = rng.permutation(len(y))
        x, y = x[order].astype(float), y[order].astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        kept_out = max(1, len(y) // 5)
        fit_x, fit_y = x[kept_out:], y[kept_out:]
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
        self.weights = [rng.normal(0, s[0] ** -0.5, s) if i in (0, 2) else np.zeros(s) for i, s in enumerate(shapes)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(fit_y)), max(1, len(fit_y) // 256)):
                step += 1
                for i, slope in enumerate(self.slopes(fit_x[rows], fit_y[rows])):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope**2
                    self.weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        logits = self.logits(x[:kept_out])
        grid = np.geomspace(0.25, 8, 61)
        self.temperature = float(grid[np.argmin([self.loss(logits / t, y[:kept_out]) for t in grid])])

    @staticmethod
    def loss(logits: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2[0]

    def slopes(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.maximum(x @ w1 + b1, 0)
        error = (1 / (1 + np.exp(-(hidden @ w2 + b2[0]))) - y) / len(y)
        back = np.outer(error, w2) * (hidden > 0)
        decay = 1e-4
        return [x.T @ back + decay * w1, back.sum(axis=0), hidden.T @ error + decay * w2, np.array([error.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        logits = self.logits((x.astype(float) - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1); rows that are held out are never fitted.
    """
    texts = docs.select(whole(F.col(text_col)).cast("binary").alias("text"))
    rows = materialize(pooled(docs, word_vectors(texts), id_col, text_col), "pooled")
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("labelled"), "quality")
    usable = materialize(
        rows.filter(~held_out(F.col("doc_id")))
        .join(known, F.col("doc_id") == F.col("labelled"))
        .select("vector", "quality", F.xxhash64("doc_id").alias("place")),
        "labelled",
    )
    # The smallest hashes: a cut in the range of hashes, set by the count, bounds what is collected.
    share = min(1.0, 0.98 * fit_rows / max(1, usable.count()))
    cut = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    sample = sorted(usable.filter(F.col("place") <= cut).collect(), key=lambda r: (r.place, bytes(r.vector), r.quality))
    sample = sample[:fit_rows]
    x = np.frombuffer(b"".join(bytes(r.vector) for r in sample), np.float32).reshape(-1, DIMENSIONS)
    network = Network(x, np.array([r.quality for r in sample], float))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch["vector"]), np.float32).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": network.score(vectors)})

    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "vector").mapInPandas(
        score, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    Of rows that repeat an id all stay if one is accepted; rows without an id always stay.
    """
    (name,) = fresh(docs, "rejected")
    rejected = (
        scores(docs.select(id_col, text_col), labels, id_col, text_col)
        .filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("predicted").alias("kept"))
        .filter("kept = 0")
        .select(F.col("doc_id").alias(name))
    )
    return docs.join(rejected, docs[id_col] == rejected[name], "left_anti")
