"""Quality rules with distribution divergence.

Counting rules (words, repeated words and lines, symbols) come first. Then the document's
histograms of character classes and of common words are compared with those of its language
by Jensen-Shannon distance (base 2, from 0 to 1). A document far from its language is not
kept. The references are sums over all documents of a language, whatever its size; a
histogram too short to judge is not compared.

Chance alone moves a text of n words by about c / sqrt(n) from its language, so the limit for
common words is COMMON_FACTOR times what is usual at that length: c is the median of distance
times sqrt(n) over all documents of the language that are long enough. Below COMMON_FLOOR no
distance counts as far, as long texts differ by their subjects too.

Null text has no words and fails. A null language is a language of its own. Null and
repeated ids get a row each. An empty table gives an empty result; other columns are
ignored. References have one row per language; they are joined like any table, so their
number needs no bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskgraph.llm.columns import whole
from riskgraph.session import materialize

# Common words of four languages (fixed values).
COMMON_WORDS = (
    "the of and to in is that for it was on are as with be at by this from or "
    "le la les et des en un une est que pour dans ce il qui ne sur pas plus par "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es werden "
    "el los las del y se con una su al lo como pero sus o este si ya todo esta"
).split()
LEAST_WORDS = 50
LEAST_CHARS = 200
LEAST_COMMON = 100
CLASS_LIMIT = 0.32
COMMON_FLOOR = 0.25
COMMON_FACTOR = 1.4
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def byte_classes() -> np.ndarray:
    """Class of each byte: small, capital, digit, space, sentence sign, symbol, other ASCII, letter beyond ASCII, rest of a letter."""
    classes = np.full(256, 6)
    classes[[c for c in range(128) if chr(c).islower()]] = 0
    classes[[c for c in range(128) if chr(c).isupper()]] = 1
    classes[[c for c in range(128) if chr(c).isdigit()]] = 2
    classes[list(SPACES)] = 3
    classes[list(b".,;:!?'\"()-")] = 4
    classes[list(SYMBOLS)] = 5
    classes[192:] = 7
    classes[128:192] = 8
    return classes


CLASSES = byte_classes()
N_CLASSES = 8
N_COMMON = len(set(COMMON_WORDS)) + 1
# A common word as it stands in a sentence: capital or not, with or without a sign behind it.
COMMON = {
    (form + sign).encode(): i
    for i, word in enumerate(dict.fromkeys(COMMON_WORDS))
    for form in (word, word.capitalize())
    for sign in ("", *".,;:!?")
}


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside windows of three that occur at least twice."""
    if len(numbers) < 4:
        return 0
    base = int(numbers.max()) + 1
    pair = numbers[:-1] * base + numbers[1:]
    if base > 2_000_000:  # else three numbers fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * base + numbers[2:]
    order = np.argsort(triple, kind="stable")
    equal = triple[order[1:]] == triple[order[:-1]]
    twice = np.zeros(len(triple), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    marked = np.zeros(len(numbers), bool)
    for shift in range(3):
        marked[shift : shift + len(twice)] |= twice
    return int(marked.sum())


def measures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class and common-word histograms."""
    bytes_seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(CLASSES, weights=bytes_seen, minlength=9)[:N_CLASSES].astype(np.int64)
    words = text.split()
    seen: defaultdict = defaultdict(count().__next__)
    numbers = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    times = np.bincount(numbers, minlength=len(seen))
    known = [word for word in seen if word in COMMON]
    common = np.bincount([COMMON[w] for w in known], weights=[times[seen[w]] for w in known], minlength=N_COMMON)
    common[-1] = len(words) - common.sum()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(classes.sum() - classes[3]),
        int(bytes_seen[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
        classes.tolist(),
        common.astype(np.int64).tolist(),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"]
        for batch in batches:
            out = pd.DataFrame([measures(t) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "lang", batch["lang"].to_numpy())
            yield out

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00")).alias("lang"),
        whole(F.col(text_col)).cast("binary").alias("text"),
    )
    return rows.mapInPandas(
        compute,
        f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, classes array<long>, common array<long>",
    )


def references(measured: DataFrame) -> DataFrame:
    """of_lang, all_classes, all_common: histograms summed over all documents of a language."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(N_COMMON)]
    return measured.groupBy(F.col("lang").alias("of_lang")).agg(*sums).select(
        "of_lang",
        F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("all_classes"),
        F.array(*[f"w{i}" for i in range(N_COMMON)]).alias("all_common"),
    )


@F.pandas_udf(DoubleType())
def distance(ours: pd.Series, theirs: pd.Series) -> pd.Series:
    """Jensen-Shannon distance of two histograms; NULL if one is empty."""
    if not len(ours):
        return pd.Series([], dtype="float64")
    p, q = np.stack(ours.to_list()).astype(float), np.stack(theirs.to_list()).astype(float)
    a, b = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    p, q = p / np.where(a > 0, a, 1), q / np.where(b > 0, b, 1)
    middle = (p + q) / 2
    # An empty cell of one side adds nothing.
    safe = np.where(middle > 0, middle, 1)
    parts = p * np.log2(np.where(p > 0, p, safe) / safe) + q * np.log2(np.where(q > 0, q, safe) / safe)
    out = np.sqrt(np.maximum(parts.sum(axis=1) / 2, 0))
    return pd.Series(np.where((a > 0).ravel() & (b > 0).ravel(), out, np.nan)).replace({np.nan: None}).astype("Float64")


def usual(compared: DataFrame) -> DataFrame:
    """of_lang, usual: median of distance times sqrt(words) over the texts long enough.

    Two decimals bound the distinct values that a language's exact median counts.
    """
    scaled = F.round(F.col("common_distance") * F.sqrt("n_words"), 2)
    long_enough = compared.filter(F.col("n_words") >= LEAST_COMMON)
    return long_enough.groupBy(F.col("lang").alias("of_lang")).agg(F.percentile(scaled, 0.5).alias("usual"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, class_distance, common_distance, base_failed and kept for every row."""
    measured = materialize(measure(docs, id_col, text_col, lang_col), "measured")
    reference = materialize(references(measured), "references")
    compared = measured.join(reference, F.col("lang") == F.col("of_lang"), "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"),
        distance("classes", "all_classes").alias("class_distance"),
        distance("common", "all_common").alias("common_distance"),
    )
    compared = materialize(compared, "compared")
    joined = compared.join(usual(compared), F.col("lang") == F.col("of_lang"), "left")
    far_classes = (F.col("chars") >= LEAST_CHARS) & (F.col("class_distance") > CLASS_LIMIT)
    limit = F.greatest(F.lit(COMMON_FLOOR), COMMON_FACTOR * F.col("usual") / F.sqrt("n_words"))
    far_common = (F.col("n_words") >= LEAST_COMMON) & (F.col("common_distance") > limit)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(far_classes, F.lit(False)) | F.coalesce(far_common, F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "common_distance",
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )
