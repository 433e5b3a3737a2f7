"""Phrase mining against plain counting: counts, border failures, cuts, containment, ranks."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskgraph.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, phrase long"


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    inside = {}
    for (lang, p), c in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                inside[key] = max(inside.get(key, 0), c)
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or inside.get((lang, p), 0) >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        text = " ".join(p)
        out.setdefault(lang, []).append((-score, -a, text.encode(), text, f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i + 1, t, -a, l, r, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, _, t, l, r) in enumerate(sorted(found)[:top])
    }


def corpus(seed, docs=200):
    rng = random.Random(seed)
    phrases = [[rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words += rng.choice(phrases)
            if rng.random() < 0.3:
                words.append(rng.choice([".", ",", "\n", "\t", "É", "X", "\x0b"]))
        text = " ".join(words) if i else None
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows + rows[5:9]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("least,top", [(5, 2000), (20, 7)])
def test_result_equals_plain_counting(spark, least, top):
    rows = corpus(1)
    found = {tuple(r) for r in collocations.collocations(frame(spark, rows), least, top).collect()}
    assert found == plain(rows, least, top) and len(found) > 10


def test_a_sample_that_misses_everything_changes_nothing(spark):
    """No, a wrong or a tiny sample, and a filter too small to tell phrases apart, give the same phrases."""
    rows = corpus(2)
    texts = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    other = spark.createDataFrame([("en", bytearray(b"quite other words here. a0 a0"))] * 9, "lang string, text binary")
    wanted = plain(rows, 5, 10**6)
    for sample, words in ((texts.limit(0), 64), (other, 64), (texts.limit(9), 2**12), (texts, 1)):
        found = collocations.frequent_phrases(texts, sample, 5, 2, words)
        assert {tuple(r) for r in collocations.ranked(found, 10**6).collect()} == wanted


def test_exact_beyond_64_bits(spark):
    """Counts near 10**12: the products need more than 64 bits."""
    a, n = 999_999_999_989, 98_765_432_109_871
    rows = [("en", 0, "", n), ("en", 1, "x", a + 12), ("en", 1, "y", a + 77), ("en", 2, "x y", a)]
    found = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    (row,) = collocations.ranked(found).collect()
    assert row.score == 1000 * a * n // ((a + 12) * (a + 77))


def test_edges(spark):
    assert collocations.collocations(frame(spark, corpus(1)).limit(0)).collect() == []
    rows = [(None, None, None), (1, "", "en"), (1, ". . \n", "en"), (2, "É  b", "x")]
    found = {tuple(r) for r in collocations.collocations(frame(spark, rows * 3), 3, 2000).collect()}
    assert found == plain(rows * 3, 3, 2000) and found


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 100)
    for text in (b"a b c. " * 40, b"word " * 60, b"no end " * 30 + b"." + b"x y " * 90, b"", b"." * 300):
        parts = list(collocations.parts_of(text))
        assert b" ".join(parts).split() and b"".join(parts).replace(b" . ", b".") == text or not text
    rows = [(1, "one two three four. " * 500, "en"), (2, "one two " * 20_000, "en")]
    monkeypatch.undo()
    found = {tuple(r) for r in collocations.collocations(frame(spark, rows), 100, 50).collect()}
    assert found == plain(rows, 100, 50)
