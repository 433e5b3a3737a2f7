"""The pipeline's near duplicates against brute-force Jaccard of five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import pandas as pd
from riskgraph.llm import similar


def plain_sets(texts):
    words = {i: t.lower().split() for i, t in texts.items()}
    return {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}


def plain_roots(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited_texts():
    """Families of texts with one to forty changed words, most of them near similarity 0.8, and short texts."""
    rng = random.Random(3)
    texts = {}
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 600))]
        for _ in range(8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 1 + len(copy) // 22)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    return texts | {1000: "two words", 1001: "Two  words", 1002: "", 1003: " "}


def test_stage_equals_brute_force(spark):
    texts = edited_texts()
    roots = plain_roots(plain_sets(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {i for i, r in roots.items() if r == i}
    assert 60 < len(kept) < 400
    found = {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    assert found == roots


def near_copies(seed, n, changed):
    """Copies of one text, each with its own places changed into words of its own."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(n):
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.choice(changed)):
            copy[at] = f"x{i}y{at}"
        texts[i] = " ".join(copy)
    return texts


def test_large_group_of_near_copies_equals_brute_force(spark, monkeypatch):
    """Most pairs of the group lie between similarity 0.5 and 0.85; the group falls into many components."""
    texts = near_copies(4, 350, (0, 1, 2, 3, 4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    assert found == plain_roots(plain_sets(texts))
    assert 20 < len(set(found.values())) < 350


def test_near_copies_below_the_limit_never_meet():
    """Sets with more than a ninth of their own shingles make no pair under the ones they share."""
    rows = pd.DataFrame({"key": 7, "node": range(5000), "size": 100, "at": 12, "root": range(5000)})
    for every in (False, True):
        assert sum(map(len, similar.meet(every)(iter([rows])))) == 0
    # Of sets that may all be alike only a tree is tried, whatever their number.
    close = rows.assign(at=3)
    assert sum(map(len, similar.meet(False)(iter([close])))) == 4999


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other words here"), (3, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, kept long")
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "3", "None", "None"]
    assert similar.drop_similar(docs.limit(0)).collect() == []


def test_simhash_alone_gives_candidates_that_are_verified(spark, monkeypatch):
    """Without MinHash pairs, fingerprints that link still bring a near copy in, but no text below the limit."""
    monkeypatch.setattr(similar, "stars", lambda batches: iter(()))
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    edited = [*words[:-1], "other"]
    # The same words three by three, so an equal fingerprint, but other windows of five.
    cycle = ["a b a b a b a b", "b a b a b a b a"]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(edited)), (3, cycle[0]), (4, cycle[1]), (5, "a b a b"), (6, None), (7, "")],
        "doc_id long, text string",
    )
    found = {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    assert found[2] == 1 and found[4] == found[3] and found[5] == 5 and found[7] == found[6] == 6
