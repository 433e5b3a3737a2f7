"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme marks
and cue words for accounts. At each anchor a small parser expands to the boundaries of what
could be there and validates it. An anchor inside what its kind has already consumed is
passed over, which gives leftmost matches that do not overlap; a match that fails its check
is consumed as well and not tried again.

Kinds in order: email, ip, card and phone; added ones: account (a number after a cue word,
an IBAN only with a right check number) and login (user and password in a URL). Spans are
half open and count code points. Each text is scanned whole, in time linear in its length.
Null text counts as empty; null and repeated ids get a row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import whole

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
CUES = ("iban", "account", "acct")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{6,17})(?![A-Za-z0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._~%-]{1,256}:[^\s/@:]{1,256}@")


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in ("@", "+", "://", *"0123456789"):
        found.add_word(sign, (len(sign), "digit" if sign.isdigit() else sign))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, (len(form), "cue"))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-1::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(doubled)) % 10 == 0


def passes_iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def left_end(text: str, at: int, allowed: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all spans, sorted."""
    spans = []
    done = [0] * len(KINDS)

    def add(kind: int, start: int, end: int, right: bool = True) -> None:
        done[kind] = end
        if right:
            spans.append((kind, start, end))

    for last, (size, anchor) in anchors().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= done[1]:
                if match := IP.match(text, at):
                    parts = [p.lstrip("0") for p in match[0].split(".")]
                    add(1, at, match.end(), all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts))
                else:
                    done[1] = DIGITS.match(text, at).end()
            if at >= done[2] and (match := CARD.match(text, at)):
                digits = match[0].replace(" ", "").replace("-", "")
                add(2, at, match.end(), 13 <= len(digits) <= 19 and passes_luhn(digits))
        elif anchor == "@":
            start = left_end(text, at, LOCAL, done[0])
            if start < at and (match := DOMAIN.match(text, at + 1)):
                add(0, start, match.end())
        elif anchor == "+":
            if at >= done[3] and (match := PHONE.match(text, at)):
                add(3, at, match.end(), 9 <= len(re.sub("[^0-9]", "", match[0])) <= 15)
        elif anchor == "cue":
            if (match := ACCOUNT.match(text, last + 1)) and match.start(1) >= done[4]:
                value = match[1]
                add(4, match.start(1), match.end(1), value[0].isdigit() or passes_iban(value))
        elif match := LOGIN.match(text, last + 1):
            start = left_end(text, at, SCHEME, max(done[5], at - 32))
            if start < at:
                add(5, start, match.end())
    return sorted(spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) by kind as listed, then start, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in find(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInPandas(search, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def listing(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
