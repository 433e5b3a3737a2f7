"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pathlib import Path

from riskgraph.llm import (
    decontaminate, divergence, lines, packing, personal, quality, secret_scan, simhash, substrings, url_rules,
)

CLASHES = "key long, cut_id long, cut_key long, gone long, kept long, hit_id long, hit_key long, own_id long, rejected long, spans long, vector long"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASHES}"
N_EXTRA = CLASHES.count(",") + 1
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000)) + "\n" + "a" * 100_000
ROWS = [
    (None, None, None, None),
    (1, None, "en", "s"),
    (2, "", "en", None),
    (3, " \n\t ", None, "s"),
    (4, "same words in both rows here", "en", "s"),
    (4, "same words in both rows here", "en", "s"),
    (4, "other words under an id that is taken", "en", "t"),
    (5, LONG, "en", "s"),
    (None, "a text without an id", "en", "s"),
    (6, "ÀÉ \u2003 ſ K \u0000 \U0001f600", "xx", "t"),
]
RULES = [("org", "/", "allow"), (None, "/", "block"), ("org", "/", "block")]
LABELS = [(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)]


def tokenizer():
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


OPERATORS = {
    "near_duplicates": lambda d, b, l: simhash.near_duplicates(d),
    "secrets": lambda d, b, l: secret_scan.scan(d),
    "quality": lambda d, b, l: quality.scores(d, l),
    "personal": lambda d, b, l: personal.scan(d),
    "divergence": lambda d, b, l: divergence.judge(d),
    "lines": lambda d, b, l: lines.remove_boilerplate(d, n_lines="n_lines", n_removed="n_removed"),
    "repeats": lambda d, b, l: substrings.remove_repeats(d),
    "contamination": lambda d, b, l: decontaminate.contamination(d, b),
}
FILTERS = {
    "near_duplicates": lambda d, b, l: simhash.drop_near_duplicates(d),
    "quality": lambda d, b, l: quality.keep_good(d, l),
    "contamination": lambda d, b, l: decontaminate.drop_contaminated(d, b),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, *[7] * N_EXTRA) for r in ROWS], SCHEMA)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "a text without"), (3, "words in both"), (3, "words in both")], "item_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return docs, benchmark, labels


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, tables, name):
    rows = OPERATORS[name](*tables).collect()
    assert len(rows) == len(ROWS)
    ids = sorted(str(r.doc_id) for r in rows)
    assert ids == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tables, name):
    empty = [spark.createDataFrame([], t.schema) for t in tables]
    assert OPERATORS[name](*empty).collect() == []
    assert len(OPERATORS[name](tables[0], *empty[1:]).collect()) == len(ROWS)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(spark, tables, name):
    kept = FILTERS[name](*tables)
    assert kept.columns == tables[0].columns
    assert {tuple(r)[4:] for r in kept.collect()} == {(7,) * N_EXTRA}


def test_line_and_repeat_removal_keep_extra_columns(spark, tables):
    docs = tables[0]
    assert lines.remove_boilerplate(docs).columns == docs.columns
    assert substrings.remove_repeats(docs).columns == [*docs.columns, "n_words", "n_removed"]


def test_packing_edges(spark, tables):
    docs = tables[0]
    rows = packing.pack(docs, tokenizer()).collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in rows)
    # A null or blank text is the end token alone.
    assert [r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(spark.createDataFrame([], docs.schema), tokenizer()).collect() == []


def test_url_edges(spark):
    urls = [(None, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG"), (4, "http://A.ORG/x"), (5, "x://"), (6, "http://" + "a." * 300 + "org/" + "p" * 50_000)]
    pages = spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_rules.judge(pages, rules, blocks=3).collect()
    assert len(found) == len(urls)
    # Of equal rules block wins; an empty path does not start with "/".
    assert {(r.page_id, r.verdict) for r in found if r.rule} == {(4, "block"), (6, "block")}
    assert {r.host for r in found if r.page_id in (1, 2, 3, 5)} == {""}
    none = spark.createDataFrame([], rules.schema)
    assert {r.verdict for r in url_rules.judge(pages, none).collect()} == {"allow"}
    assert url_rules.judge(spark.createDataFrame([], pages.schema), rules).collect() == []
