"""Periodic runs against brute force: Lyndon arrays, runs, collapsed texts, and the query's planted documents."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from riskgraph.llm import periods, queries

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=24, copies=3):
    """All maximal stretches whose smallest period makes them long enough."""
    n, found = len(words), set()
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            inner = words[i : i + length]
            # Shorter periods come first; a period that a shorter one divides is not the smallest.
            smallest = not any(q % r == 0 and inner[: length - r] == inner[r:] for r in range(1, q))
            if length >= max(least, copies * q) and smallest:
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def random_words(rng):
    words = [rng.choice("abcde") for _ in range(rng.randrange(0, 30))]
    for _ in range(rng.randrange(0, 4)):
        root = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
        words += (root * rng.randrange(1, 12))[rng.randrange(0, 3) :]
        words += [rng.choice("abcde") for _ in range(rng.randrange(0, 9))]
    return words


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(3) for _ in range(rng.randrange(0, 24))]
        assert periods.lyndon_array(s) == plain_lyndon(s)


def test_runs_of_many_texts_equal_brute_force():
    rng = random.Random(2)
    texts = [random_words(rng) for _ in range(400)]
    rows, counts = periods.runs_of_texts([[w.encode() for w in t] for t in texts])
    at = 0
    for words, n in zip(texts, counts, strict=True):
        found = [(s, e - s, p) for s, e, p in rows[at : at + n].tolist()]
        assert found == plain_runs(words), words
        at += n
    assert at == len(rows) > 300


def test_runs_without_bounds_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 60))]
        found = [(s, e - s, p) for s, e, p in periods.runs_of(np.array(words), least=2, copies=2).tolist()]
        assert found == plain_runs(words, 2, 2), words


def test_words_that_deceive_the_hashes():
    """Words in the order of the Thue-Morse sequence give equal hashes to unequal stretches."""
    t = [bin(i).count("1") % 2 for i in range(4096)]
    words = t[:2048] + [1 - x for x in t[:2048]] + t[:2048] + [5, 6, 7] * 20 + [1 - x for x in t[:2048]] + t[:1024] * 3
    found = [(s, e - s, p) for s, e, p in periods.runs_of(np.array(words)).tolist()]
    same = {(s, n, p) for s, n, p in found if all(words[i] == words[i + p] for i in range(s, s + n - p))}
    assert same == set(found)
    assert (6144 - 1 if words[6143] == 7 else 6144, 60, 3) in same
    assert any(p == 1024 and n >= 3072 for _, n, p in same)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = [w.decode() for w in planted(doc_id, (text or "").encode().split())]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 1500}
    rows = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert set(rows) == set(docs) and len(short) > 150
    assert {i: rows[i] for i in short} == {i: expected(i, t) for i, t in short.items()}
    assert sum(r[1] > 0 for r in rows.values()) > 10


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, ""), (2, " \n\t "), (3, "a " * 30), (3, "a " * 30), (4, "x y z")]])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, body long")
    found = periods.find_runs(df).collect()
    assert len(found) == len(rows)
    for r in found:
        words = (r.text or "").split()
        assert r.n_words == len(words) and r.body == 7
        assert [tuple(x) for x in r.runs] == plain_runs(words)
        assert r.collapsed == ("a" if r.runs else " ".join(words))


def test_very_long_text(spark):
    """A million words, periodic with a long period and with a short one."""
    root = [f"w{i}" for i in range(100_000)]
    words = root * 4 + ["a", "b"] * 300_000
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (row,) = periods.find_runs(df).collect()
    assert [tuple(r) for r in row.runs] == [(0, 400_000, 100_000), (400_000, 600_000, 2)]
    assert row.collapsed == " ".join([*root, "a", "b"])
