"""Targets of small sources, and the mixture of many small ones."""

from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from riskgraph.llm import packing


def definition():
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def packed(spark, docs, **more):
    """Rows in the order of the sequences, with the source of each."""
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(docs)], "doc_id long, source string, text string")
    rows = packing.pack(df.repartition(4), definition(), window=256, **more).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r)
    for own in texts.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist()
        assert sum(r.length for r in own) == own[0].doc_tokens
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at = [r.sequence_id * 256 + r.offset for r in rows]
    assert at == np.cumsum([0, *[r.length for r in rows][:-1]]).tolist()
    return [(docs[r.doc_id][0], a, r.length) for r, a in zip(rows, at, strict=True)]


def test_targets_of_small_sources(spark):
    docs = [("large", "word " * 900)] * 60 + [("tiny", "word " * 100)] + [("last", "word " * 5000)]
    rows = packed(spark, docs, targets={"tiny": 0.2, "last": 0})
    # A target above the natural share is met from the first window on.
    early = Counter()
    for source, at, length in rows:
        if at < 256:
            early[source] += length
    assert early["tiny"] >= 40
    others = max(at + length for source, at, length in rows if source != "last")
    assert min(at for source, at, length in rows if source == "last") >= others


@pytest.mark.parametrize("targets", [None, {"s7": 0.002}])
def test_small_sources_share_every_stretch(spark, targets):
    docs = [(f"s{i % 300}", "word " * 99) for i in range(900)]
    rows = packed(spark, docs, targets=targets)
    total = sum(length for _, _, length in rows)
    for part in range(1, 10):
        served = Counter()
        for source, at, length in rows:
            served[source] += max(0, min(length, total * part // 10 - at))
        for i in range(300):
            if targets is None:
                assert abs(served[f"s{i}"] - 30 * part) <= 2 * packing.TURN
        # A source of three fifths of the others' weight is left behind.
        if targets and part == 9:
            assert served["s7"] <= 0.6 * 270 + 2 * packing.TURN
