"""Derived trigram queries, and texts with very many matches or removed lines."""

import re
import time

import pytest

from riskgraph.llm import lines, secret_scan
from riskgraph.llm.secret_scan import ANYWHERE, Rule, trigram_query, trigrams

# What a match of each rule contains, as literals.
LITERALS = {
    "assign": [["password"], ["passwd"], ["secret"], ["token"], ["api_key"], ["apikey"]],
    "access": [["akia"]],
    "github": [["ghp_"], ["gho_"], ["ghu_"], ["ghs_"], ["ghr_"]],
    "google": [["aiza"]],
    "pemkey": [["-----begin ", "private key-----"]],
    "slack": [["xoxa-"], ["xoxb-"], ["xoxp-"], ["xoxr-"], ["xoxs-"]],
}


def as_query(alternatives):
    return frozenset(frozenset().union(*map(trigrams, a)) for a in alternatives)


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_derived_queries_of_the_rules(rule):
    assert trigram_query(rule.regex) == (as_query(LITERALS[rule.kind]) if rule.kind in LITERALS else ANYWHERE)


@pytest.mark.parametrize("regex,alternatives", [
    ("abc", [["abc"]]), ("ab", None), ("abcd?", [["abc"]]), ("(abc)?", None), ("(abc|def)gh", [["abcgh"], ["defgh"]]),
    ("abc|de", None), ("abc.*xyz", [["abc", "xyz"]]), ("(?:abc|abcd)+", [["abc"]]), ("a{4}", [["aaaa"]]), ("a{2,}b", None),
    ("[ab]cd", [["acd"], ["bcd"]]), ("[^a]bcd", [["bcd"]]), ("(?i)ABC", [["abc"]]), ("[a-z]{3}", None), ("abc\\b", [["abc"]]),
    ("x++abc", [["abc"]]), ("(unbalanced", None), ("", None), ("(?=abc)d", None), ("(a|b)(c|d)(e|f)", [[x + y + z] for x in "ab" for y in "cd" for z in "ef"]),
])
def test_derived_queries(regex, alternatives):
    assert trigram_query(regex) == (ANYWHERE if alternatives is None else as_query(alternatives))


def test_rules_of_a_user_lose_nothing(spark):
    texts = ["key-AB12", "k AB9 xyz", "abc.xyz", "abcd", "ABC xyz xyz", "12", "", "Foo77 barbar foo", "x" * 50, "dEf1 aBc1"]
    rules = tuple(Rule(f"r{i}", r) for i, r in enumerate(
        ["[A-Z]{2}[0-9]+", "abc.*xyz", "abc|[0-9]{2}", "(foo|bar)+", "xyz( xyz)?", "[dD]", "(?:[aA][bB][cC]|d[eE]f)1", "x{3,}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.scan(docs, rules).collect():
        text = texts[row.doc_id]
        want = sorted((m.start(), i, r.kind, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.regex, text))
        assert [tuple(s) for s in row.spans] == want


def test_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"{i:024x} é " for i in range(n)) + "token = abcdefg"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    (row,) = secret_scan.scan(docs).collect()
    assert time.time() - start < 20
    assert [(s.start, s.end) for s in row.spans[:-1]] == [(27 * i, 27 * i + 24) for i in range(n)]
    assert text[row.spans[-1].start : row.spans[-1].end] == "token = abcdefg"


def test_hundred_thousand_removed_lines_in_one_text(spark):
    n = 100_000
    shared = "\n".join(f"shared line {i}" for i in range(n))
    docs = spark.createDataFrame([(i, f"own {i}\n{shared}\nlast {i}", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    start = time.time()
    found = {r.doc_id: r for r in lines.remove_boilerplate(docs, n_lines="n", n_removed="gone").collect()}
    assert time.time() - start < 40
    assert found[0].text == f"own 0\n{shared}\nlast 0"
    assert [(found[i].text, found[i].n, found[i].gone) for i in range(1, 6)] == [(f"own {i}\nlast {i}", n + 2, n) for i in range(1, 6)]
