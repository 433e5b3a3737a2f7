"""The limit for common words: gibberish and wrong-language texts go, ordinary texts stay."""

import random

from riskgraph.llm import divergence

ENGLISH = "the of and to in is that for it was on are as with be at by this from or".split()
GERMAN = "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es werden".split()


def text(rng, common, n):
    """``n`` words, four in ten of them common, the others of letters alone."""
    other = ["".join(rng.choices("aeinrstlodhmcu", k=rng.randrange(4, 9))) for _ in range(n)]
    return " ".join(rng.choice(common) if common and rng.random() < 0.4 else w for w in other)


def test_gibberish_and_wrong_language(spark):
    rng = random.Random(11)
    rows = {}
    for lang, own, foreign in (("en", ENGLISH, GERMAN), ("de", GERMAN, ENGLISH)):
        for kind, common, number in (("ordinary", own, 150), ("gibberish", None, 5), ("foreign", foreign, 5)):
            for i in range(number):
                rows[f"{lang} {kind} {i}"] = (text(rng, common, (100, 130, 200, 400, 1500)[i % 5]), lang)
    docs = spark.createDataFrame([(i, *r) for i, r in rows.items()], "doc_id string, text string, lang string")
    found = {r.doc_id: r for r in divergence.judge(docs).collect()}
    assert not any(r.base_failed or r.class_distance > divergence.CLASS_LIMIT for r in found.values())
    assert {i for i, r in found.items() if not r.kept} == {i for i in rows if "ordinary" not in i}
