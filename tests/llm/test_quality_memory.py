"""Memory of the quality classifier's tasks."""

import tracemalloc

import numpy as np
import pandas as pd

from riskgraph.llm import quality


def test_word_vectors_take_little_memory_beyond_the_texts():
    """Five megabytes of text at once: 450 MB more in pieces of four megabytes."""
    words = np.random.default_rng(3).integers(0, 30_000, (2000, 400))
    batch = pd.DataFrame({"text": [b" ".join(b"w%d" % x for x in row) for row in words]})
    sums = np.zeros((quality.PLACES, quality.DIMENSIONS), np.int64)
    places, table = quality.Places(), quality.index_vectors()
    tracemalloc.start()
    try:
        for part in quality.parts_of(batch):
            quality.add_contexts(sums, list(part["text"]), places, table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6
    whole = np.zeros_like(sums)
    quality.add_contexts(whole, list(batch["text"]), places, table)
    assert (whole == sums).all() and sums.any()
