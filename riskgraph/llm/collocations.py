"""Collocations: phrases that occur often and whose parts meet more often than by chance.

Toivonen's mining. A sample of the texts, searched with a lowered least count, proposes
phrases. One pass over all texts then counts every word and every phrase whose parts without
the last and without the first word are proposed: the proposed phrases and their negative
border. A border phrase that turns out to be frequent is a failure of the sample. If there
are any, an expansion pass counts the phrases that were left out although both of those parts
are frequent or are counted in this very pass. As parts of a frequent phrase are frequent,
that reaches every frequent phrase, by induction over its length; nothing is left after it.
So the sample decides what is counted first, never what is found.

The border is mostly rare phrases, so it is counted by 64-bit hashes, without texts. A count
of a hash is never too small. What it calls frequent is counted again, exactly and by the
phrases themselves, in the pass that also does the expansion; so hashes decide nothing
either. Tasks know sets of phrases as bit filters of at most FILTER_WORDS longs, whatever
their number; phrases that pass by chance are counted too, which costs time and changes
nothing. Counts are summed in the tasks first.

Texts: A-Z are lower-cased; pieces end at . , ; : ! ? and line breaks; words are what spaces
and tabs leave of them. Phrases lie within pieces. Everything is counted per language, a null
language is ``und``. Null and empty texts have no words; repeated rows count each. An empty
table gives an empty result; other columns are ignored. Long texts are cut between pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.columns import broadcast_if_small, whole
from riskgraph.session import materialize

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
# Share of the texts in the sample, and of the expected count that the sample asks for.
SAMPLE_SHARE = 0.1
LOWERED = 0.9
# Longs in the filter of known phrases, at most, and bits for each phrase below that.
FILTER_WORDS = 2**21
FILTER_BITS = 12
# Bytes of text whose words are held at once.
BATCH_BYTES = 1_000_000
SALTS = 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)
END = b"."
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes(END[0] if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
ROW = "lang string, size int, phrase string, n long"


def hashes_of(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def places_in_filter(hashes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its long in the filter and the three bits there."""
    mixed = hashes ^ (hashes >> np.uint64(32))
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    bits = [np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63)) for shift in (0, 6, 12)]
    return ((mixed >> np.uint64(20)) % np.uint64(n_words)).astype(np.int64), bits[0] | bits[1] | bits[2]


def known(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place, bits = places_in_filter(hashes, len(filter_))
    return filter_[place] & bits == bits


class Grams:
    """All words of some texts in a row, with hashes of the phrases that start at each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        lang_number, self.langs = pd.factorize(np.array(langs, object))
        tokens: list[bytes] = []
        sizes = []
        for text in texts:
            before = len(tokens)
            tokens += text.split()
            tokens.append(END)
            sizes.append(len(tokens) - before)
        self.tokens = tokens
        self.lang = np.repeat(lang_number, sizes)
        number, distinct = pd.factorize(np.array(tokens, object))
        words = distinct.tolist()
        self.valid = [np.array([w != END for w in words], bool)[number]]
        self.number, self.words = number, words
        self.hashes = list(self.lane(1))
        for _ in range(1, MOST_WORDS):
            last = self.valid[-1]
            self.valid.append(last[:-1] & self.valid[0][len(self.valid[0]) - len(last) + 1 :])

    def lane(self, seed: int) -> Iterator[np.ndarray]:
        """Hashes of the phrases of one, two, ... words that start at each place."""
        of_word = hashes_of(self.words, seed)[self.number]
        now = hashes_of([x.encode() for x in self.langs], seed)[self.lang] * FACTOR + of_word
        yield now
        for k in range(1, MOST_WORDS):
            now = now[:-1] * FACTOR + of_word[k:]
            yield now

    def both(self, k: int, these: np.ndarray) -> np.ndarray:
        """Where phrases of k + 1 words lie both of whose parts of k words are in ``these``."""
        return these[:-1] & these[1:] & self.valid[k]

    def chosen(self, start: np.ndarray | int, more: np.ndarray | None) -> list[np.ndarray]:
        """Places of the phrases to count, by number of words.

        ``start`` is the filter of proposed phrases, or the number of words up to which all
        phrases count. With ``more``, the filter of frequent ones, only what ``start`` leaves
        out counts.
        """
        if isinstance(start, int):
            first = [v if k < start else np.zeros(len(v), bool) for k, v in enumerate(self.valid)]
        else:
            first = [self.valid[0]]
            for k in range(1, MOST_WORDS):
                first.append(self.both(k, known(start, self.hashes[k - 1])))
        if more is None:
            return first
        out = [np.zeros(len(self.valid[0]), bool)]
        for k in range(1, MOST_WORDS):
            reached = known(more, self.hashes[k - 1]) | out[k - 1]
            out.append(self.both(k, reached) & ~first[k])
        return out

    def hash_counts(self, start: np.ndarray | int, more: np.ndarray | None) -> Iterator[pd.DataFrame]:
        """Counts of the chosen phrases by hash."""
        chosen = [h[at] for h, at in zip(self.hashes, self.chosen(start, more), strict=True)]
        hashes, times = np.unique(np.concatenate(chosen), return_counts=True)
        yield pd.DataFrame({"hash": hashes.view(np.int64), "n": times})

    def phrase_counts(self, start: np.ndarray, frequent: np.ndarray, expand: bool) -> Iterator[pd.DataFrame]:
        """Counts of the phrases in ``frequent``, of those the expansion reaches, and of all words."""
        chosen = [at & known(frequent, h) for at, h in zip(self.chosen(start, None), self.hashes, strict=True)]
        if expand:
            chosen = [a | b for a, b in zip(chosen, self.chosen(start, frequent), strict=True)]
        for k, (places, second) in enumerate(zip(chosen, self.lane(2), strict=True)):
            at = np.flatnonzero(places)
            if not len(at):
                continue
            at = at[np.argsort(self.hashes[k][at])]
            one, two = self.hashes[k][at], second[at]
            starts = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            times, at = np.diff(np.r_[starts, len(at)]), at[starts]
            tokens = self.tokens
            yield pd.DataFrame(
                {
                    "lang": self.langs[self.lang[at]],
                    "size": k + 1,
                    "phrase": [b" ".join(tokens[i : i + k + 1]).decode() for i in at.tolist()],
                    "n": times,
                }
            )
        total = np.bincount(self.lang[self.valid[0]], minlength=len(self.langs))
        yield pd.DataFrame({"lang": self.langs, "size": 0, "phrase": "", "n": total})


def parts_of(text: bytes) -> Iterator[bytes]:
    """The text ready to be split into words, cut between pieces where it is long."""
    text = text.translate(TABLE)
    at = 0
    while len(text) - at > BATCH_BYTES:
        end = text.rfind(END, at, at + BATCH_BYTES)
        end = end if end > at else text.find(END, at + BATCH_BYTES)
        if end < 0:
            break
        yield text[at:end].replace(END, b" . ")
        at = end
    yield text[at:].replace(END, b" . ")


def batches_of(frames: Iterator[pd.DataFrame]) -> Iterator[Grams]:
    texts, langs, held = [], [], 0
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            for part in parts_of(text):
                if held and held + len(part) > BATCH_BYTES:
                    yield Grams(texts, langs)
                    texts, langs, held = [], [], 0
                texts.append(part)
                langs.append(lang)
                held += len(part)
    if texts:
        yield Grams(texts, langs)


def hash_counts(texts: DataFrame, least: int, start: Broadcast | int, more: Broadcast | None = None) -> DataFrame:
    """hash, n: chosen phrases (see ``Grams.chosen``) whose hash occurs at least ``least`` times."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = start if isinstance(start, int) else start.value
        for grams in batches_of(frames):
            yield from grams.hash_counts(first, more and more.value)

    rows = texts.mapInPandas(compute, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return materialize(rows.filter(F.col("n") >= least), "hash-counts")


def phrase_counts(texts: DataFrame, least: int, start: Broadcast, frequent: Broadcast, expand: bool) -> DataFrame:
    """lang, size, phrase, n: phrases with n >= least, and the number of words of each language (size 0)."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grams in batches_of(frames):
            yield from grams.phrase_counts(start.value, frequent.value, expand)

    rows = texts.mapInPandas(compute, ROW).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return rows.filter((F.col("size") == 0) | (F.col("n") >= least))


def filter_of(hashes: DataFrame, most_words: int) -> Broadcast:
    """The bit filter of a column of hashes; its bits are united by an aggregation."""
    n_words = min(most_words, max(64, hashes.count() * FILTER_BITS // 64))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, bits = places_in_filter(frame["hash"].to_numpy(np.int64).view(np.uint64), n_words)
            yield pd.DataFrame({"place": at, "bits": bits.view(np.int64)})

    rows = hashes.select("hash").mapInPandas(place, "place long, bits long")
    # At most ``most_words`` rows, by the bound on the filter.
    united = rows.groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(n_words, np.uint64)
    out[united["place"]] = united["bits"].to_numpy(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(
    texts: DataFrame, sampled: DataFrame, least: int = LEAST_COUNT, sample_least: int | None = None, filter_words: int = FILTER_WORDS
) -> DataFrame:
    """lang, size, phrase, n of all phrases of one to five words with n >= least; words in all as size 0.

    ``texts`` and ``sampled`` have lang and text (binary); the sample may be any texts at all.
    """
    lowered = sample_least or max(2, int(least * SAMPLE_SHARE * LOWERED))
    short = hash_counts(sampled, lowered, 2)
    proposed = short.union(hash_counts(sampled, lowered, 2, filter_of(short, filter_words)))
    start = filter_of(proposed, filter_words)
    frequent = hash_counts(texts, least, start)
    failures = frequent.join(proposed, "hash", "left_anti").limit(1).count()
    return phrase_counts(texts, least, start, filter_of(frequent, filter_words), failures > 0)


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    a is the phrase's count, l and r those of its parts at the lowest-scoring cut, n the words
    of its language; the score is floor(1000 a n / (l r)). A phrase goes if it lies in a
    longer one with the same count; phrases between the two have that count too, so those
    longer by one word tell. Ranks are by score, count, and phrase.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        whole(F.col(text_col)).cast("binary").alias("text"), F.col(id_col).alias("id"),
    )
    in_sample = F.pmod(F.xxhash64("id", "text"), F.lit(1000)) < int(1000 * SAMPLE_SHARE)
    found = frequent_phrases(texts.select("lang", "text"), texts.filter(in_sample).select("lang", "text"), least)
    return ranked(materialize(found, "frequent"), top)


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The scored and ranked phrases of a complete table of frequent ones."""
    words = F.split("phrase", " ")
    several = found.filter("size > 1").withColumn("words", words)

    def part(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    size = F.col("size")
    inner = several.filter("size > 2").select(
        "lang", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"), "n"
    ).distinct()
    left = found.filter("size > 0").select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = found.filter("size > 0").select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = found.filter("size = 0").select("lang", F.col("n").alias("total"))
    cuts = (
        several.join(inner, ["lang", "phrase", "n"], "left_anti")
        .withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        .select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    )
    whole_cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(broadcast_if_small(totals), "lang")
    exact = "decimal(19,0)"
    score = F.expr(
        f"(CAST(1000 * a AS {exact}) * CAST(total AS {exact})) div (CAST(l AS {exact}) * CAST(r AS {exact}))"
    )
    best = whole_cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "total")).alias("best"))
    flat = best.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.total").alias("n"), "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    placed = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
