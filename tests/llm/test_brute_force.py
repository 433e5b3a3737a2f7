"""Operators without SQL against plain versions; SQL agreement for the others."""

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as spark_entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from riskgraph.llm import decontaminate, divergence, graph, lines, packing, personal, secret_scan, simhash, substrings, url_rules  # noqa: E402
from riskgraph.llm.oracles import ORACLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return {r.doc_id: r for r in spark_entry.queries()[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", ORACLES)
def test_sql_agrees(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER).startswith("ok")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text):
    words = WORDS.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(values):
    root = {i: i for i in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(values):
        for b in sorted(values):
            if a < b and (values[a] ^ values[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in values}


def test_simhash(spark, texts):
    found = run(spark, "op1_simhash_near_dedup")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


def test_links_of_a_dense_ball_and_long_chains(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ball = [0x123456789ABCDEF0 ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(60)]
    chain = [(1 << k) - 1 for k in range(0, 64, 3)]
    values = dict(enumerate(dict.fromkeys([*ball, *chain])))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values.values()]
    df = spark.createDataFrame(signed, "fingerprint long")
    for compared in (4096, 8):
        monkeypatch.setattr(simhash, "COMPARED", compared)
        roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
        groups = {}
        for i, (v,) in enumerate(signed):
            groups.setdefault(roots.get(v, v), set()).add(i)
        wanted = {}
        for i, root in plain_components(values).items():
            wanted.setdefault(root, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_wide_texts_fold_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "UNPACKED", 7)
    texts = ["a b c d e f g h i j k l m n o p q r s t u v", "", "x", "a b c d", "p q r s t u v w x y z a b c d"]
    groups = [simhash.shingle_hashes(t.encode()) for t in texts]
    bits = simhash.majority_bits(np.concatenate(groups), np.array([len(g) for g in groups]))
    assert [int(b) % 2**64 for b in bits] == [plain_fingerprint(t) for t in texts]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def plain_personal(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


TRICKY = [
    "a@b@c.com x@y.com@z.org @q.com u@v. w@x..com 1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 0000001.2.3.255 1.2.3.4@a.b",
    "4111-1111 1111 1111, 4111 1111 1111 1112 +1 (988) 555-2485 ++1 2 +12345678901234567 +1-  5 é +49 30 901820",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1.1 1.1.1.1-2.2.2.2",
]


def test_personal(spark, texts):
    for text in [*TRICKY, *texts.values()]:
        found = [(personal.KINDS[k], s, e) for k, s, e in personal.find(text) if k < len(personal.BASE_KINDS)]
        assert found == plain_personal(text), text[:80]
    added = {(personal.KINDS[k], "IBAN GB82WEST12345698765432; ftp://u:p@h"[s:e]) for k, s, e in personal.find("IBAN GB82WEST12345698765432; ftp://u:p@h")}
    assert added == {("account", "GB82WEST12345698765432"), ("login", "ftp://u:p@")}


def test_secrets_base_and_added(spark):
    key = "ghp_" + "A1" * 18
    text = f'é password=token: abcdefgh TOKEN = "abc123" AKIA{"A1" * 8} AKIAAKIA0 {"0f" * 12} {key} ſecret=abcdefgh'
    (row,) = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    found = [(s.kind, text[s.start : s.end]) for s in row.spans]
    assert found == [
        ("assign", 'TOKEN = "abc123'), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12), ("github", key),
    ]


def plain_counts(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines_seen = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines_seen[:i] for i, line in enumerate(lines_seen)), len(repeated),
    )


def test_quality_rules(spark, texts):
    found = run(spark, "op5_quality_rules")
    for i, text in texts.items():
        r = found[i]
        n = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_distance():
    import pandas as pd

    ours, theirs = pd.Series([[1, 1], [1, 0], [0, 0]]), pd.Series([[1, 1], [0, 1], [1, 1]])
    found = divergence.distance.func(ours, theirs)
    assert found[0] == 0 and found[1] == 1 and pd.isna(found[2])


def test_quality_held_out(spark):
    found = run(spark, "op3_quality_classifier")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    larger = {r.doc_id: r for r in spark_entry.queries()["op3_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    unseen = [(larger[r.doc_id].predicted, r.quality) for r in labels if larger[r.doc_id].held_out]
    assert np.mean([a == b for a, b in unseen]) > 0.93
    assert np.mean([a for a, b in unseen if b == 1]) > 0.97


def test_word_tokenizer_equals_whole_texts():
    """Random texts of awkward signs; a second call has no new words."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    signs = [*"aAbHsIt09'.,;)(<|\u00b2\u0331\u0301\u0307\u00e9\u00c9\u03a3\u0130\u201c\u00bd\u4e2d\u00a0\u3000 \n\t\x1c\x85"]
    signs += ["'s", "it's.", "a,.", "...", "<|endoftext|>", " ", " ", " "]
    rng = random.Random(5)
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)] + ["", ".", "\u00b2."]
    words = packing.WordTokenizer(Path(path).read_text())
    expected = [found.ids + [packing.END] for found in whole.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [ids.tolist() for ids in words.encode([t.encode() for t in texts])] == expected


def test_word_tokenizer_forgets_late_words_only(monkeypatch):
    """With room for few words every call forgets most of them, keeps the first, and gives the same ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    monkeypatch.setattr(packing, "KEPT", 7)
    words, whole = packing.WordTokenizer(Path(path).read_text()), Tokenizer.from_file(path)
    for i in range(12):
        texts = [f"the, end. of {i}th Word{i % 3} é{i}², x{j}y. {'z' * j}" for j in range(9)] + [""]
        found = [ids.tolist() for ids in words.encode([t.encode() for t in texts])]
        assert found == [e.ids + [packing.END] for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert list(words.word)[:3] == [b"the,", b"end.", b"of"] and len(words.stem) == len(words.word)
    words.forget_late(0)
    assert [ids.tolist() for ids in words.encode([b"", b"the"])] == [[packing.END], [*whole.encode("the", add_special_tokens=False).ids, packing.END]]


@pytest.mark.parametrize("targets", [None, {"src0": 0.6, "src1": 0.0001, "src2": 0.2}])
def test_packing_round_trip(spark, texts, targets):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    rows = packing.pack(docs, Path(path).read_text(), window=256, targets=targets).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
    for number, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or number == max(sequences)


def test_schedule_keeps_the_mixture():
    totals = np.array([9_000, 300, 60_000, 25])
    schedule = packing.Schedule(totals, totals / totals.sum(), 2048)
    last = -(-int(totals.sum()) // 2048)
    served = schedule.after(np.arange(last + 1))
    assert (served[0] == 0).all() and (served[-1] == totals).all()
    assert (np.diff(served.sum(axis=1))[:-1] == 2048).all()
    wanted = np.outer(np.minimum(np.arange(last + 1) * 2048, totals.sum()), totals / totals.sum())
    assert np.abs(served - wanted).max() < 1


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13])
def test_ranks_sort_suffixes_by_their_words(window):
    tokens = np.random.default_rng(window).integers(0, 3, 300)
    ranks = substrings.prefix_ranks(tokens, window)
    stretches = [tuple(tokens[i : i + window]) for i in range(len(tokens) - window + 1)]
    place = {s: i for i, s in enumerate(sorted(set(stretches)))}
    assert ranks.tolist() == [place[s] if window > 1 else s[0] for s in stretches]


def test_repeats_of_windows_side_by_side():
    tokens = np.array([1, 2, 3, 9, 1, 2, 3, 4, 1, 2, 3, 4])
    at = np.array([0, 1, 4, 5, 8, 9])
    found = substrings.repeats_in(tokens, at, np.array([0, 0, 1, 1, 2, 2]), 3)
    assert found.tolist() == [False, False, True, False, True, True]


def test_repeats_across_batches_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = [f"w{x}" for x in rng.integers(0, 40, 30)]
        rows.append((i, " ".join(words[:15] + passage[i % 7 : 40 + i % 5] + words[15:])))
    monkeypatch.setattr(substrings, "BATCH_CHARS", 900)
    monkeypatch.setattr(substrings, "GROUP_CHARS", 700)
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    first, wanted = {}, {}
    split = {i: t.split() for i, t in rows}
    for i, w in sorted(split.items()):
        gone = set()
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone |= set(range(s, s + 13))
        wanted[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {r.doc_id: r.text for r in found} == wanted


def test_lines_keep_their_first_place(spark):
    rows = [(i, f"own {i}\n shared line\t\n\nshared line\nlast {i}", f"s{i % 6}") for i in range(12)]
    rows += [(100 + i, f"rare line\nown {i}", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in lines.remove_boilerplate(docs).collect()}
    assert found[0] == "own 0\n shared line\t\n\nlast 0"
    assert found[7] == "own 7\n\nlast 7"
    assert found[103] == "rare line\nown 3"


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "x Alpha, beta gamma delta"), (2, "gamma alpha beta"), (3, "alpha beta"), (4, "ALPHA beta-gamma")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert rows == {1: (5, 3, ["9"]), 2: (3, 0, []), 3: (2, 0, []), 4: (3, 3, ["9"])}
    index, plan = decontaminate.prepare(docs, items, slop=2)
    assert {r.doc_id for r in decontaminate.proximity_matches(index, plan).collect()} == {1, 2, 4}


def test_rule_ranges_cross_block_borders(spark):
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "sample.org", "com"]
    pages = spark.createDataFrame(
        [(i, f"http://{hosts[i % 6]}/{'ab'[i % 2]}/{i % 3}") for i in range(300)], "page_id long, url string"
    )
    listed = [("org", "/", "allow"), ("example.org", "/a", "block"), ("a.example.org", "/b/1", "block"), ("a.example.org", "/", "allow")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    for blocks in (1, 2, 17):
        for r in url_rules.judge(pages, rules, blocks=blocks).collect():
            fits = [(len(h + p), h + p, v) for h, p, v in listed if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
            assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))
