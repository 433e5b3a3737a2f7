"""Secret scans: a trigram inverted index narrows each rule to candidates, regexes verify.

From every rule's regex a Boolean trigram query is derived (``trigram_query``): alternatives,
each a set of trigrams that a match must contain. The index holds one posting (trigram,
document) for each trigram that some query names. A rule's candidates are the documents in
the intersection of an alternative's postings, united over its alternatives. A rule whose
regex has no mandatory trigram (``hex``), or none that can be derived, scans every text.

Postings of a document meet again in one aggregation keyed on the document, as a bit set
folded on the map side first; the text itself moves once, when candidates are joined to it.

Spans are half open and count code points. Kinds, in the order in which spans of one start
are listed: assign, access, hex, then added kinds by name. Null text counts as empty. Null
ids are kept and joined null-safe. Work grows with a text and its matches, not with their
product: matches are listed once and positions added up in blocks of BLOCK. Rows that repeat an id get rows of their own: their
postings unite, which only adds candidates, and each text is verified by itself. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import whole


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``regex`` finds leftmost matches that do not overlap; a match stays if group ``group``
    has at least ``least`` characters.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (
    "(" + "|".join(map(either_case, ASSIGN_WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_RULES = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pemkey", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES


# A query in disjunctive form: alternatives of trigrams. The one without any holds everywhere.
Query = frozenset[frozenset[str]]
ANYWHERE: Query = frozenset([frozenset()])
# Strings and alternatives that are kept apart; beyond them a query gets weaker, never wrong.
MOST_STRINGS = 40
MOST_ALTERNATIVES = 40


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def either(*queries: Query) -> Query:
    """Holds where one holds; alternatives that contain another are left out."""
    all_sets = frozenset().union(*queries)
    least = frozenset(a for a in all_sets if not any(b < a for b in all_sets))
    return least if len(least) <= MOST_ALTERNATIVES else ANYWHERE


def together(a: Query, b: Query) -> Query:
    both = either(frozenset(x | y for x in a for y in b))
    return both if both != ANYWHERE else (a if a != ANYWHERE else b)


def one_of(strings: set[str]) -> Query:
    return either(*(frozenset([trigrams(s)]) for s in strings))


def _strings(item) -> set[str] | None:
    """All lower-case strings of one character that a parsed item stands for, if they are few."""
    kind, value = item
    if str(kind) == "LITERAL":
        return {chr(value).lower()}
    if str(kind) == "IN":
        found: set[str] = set()
        for what, inner in value:
            if str(what) == "LITERAL":
                found.add(chr(inner).lower())
            elif str(what) == "RANGE" and inner[1] - inner[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(inner[0], inner[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    return None


def _derive(items) -> tuple[set[str] | None, Query]:
    """The strings that parsed items stand for if they are few, and the query of their matches."""
    now: set[str] = {""}
    exact, query = True, ANYWHERE

    def close() -> None:
        nonlocal now, exact, query
        query, now, exact = together(query, one_of(now)), {""}, False

    for item in items:
        kind, value = str(item[0]), item[1]
        strings, inner = _strings(item), ANYWHERE
        if kind == "SUBPATTERN":
            strings, inner = _derive(value[3])
        elif kind == "BRANCH":
            parts = [_derive(branch) for branch in value[1]]
            known = [p[0] for p in parts]
            strings = None if None in known else set().union(*known)
            inner = either(*(q if s is None else one_of(s) for s, q in parts))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            strings, inner = _derive(body)
            if strings is not None and (least, most) == (0, 1):
                strings = strings | {""}
            elif strings is not None and least and len(strings) == 1:
                now = {a + next(iter(strings)) * int(least) for a in now}
                if most == least:
                    continue
                strings, inner = None, ANYWHERE
            elif least == 0:
                strings, inner = None, ANYWHERE
            elif (least, most) != (1, 1):
                strings, inner = None, inner if strings is None else one_of(strings)
        elif kind == "AT":
            continue
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        close()
        query = together(query, inner if strings is None else one_of(strings))
        if strings is not None:
            now = strings
    if exact:
        return now, one_of(now)
    return None, together(query, one_of(now))


def trigram_query(regex: str) -> Query:
    """The trigrams of the lower-cased text that every match of the regex contains, as alternatives."""
    try:
        parsed = re._parser.parse(regex)
    except (re.error, AttributeError, OverflowError):
        return ANYWHERE
    return _derive(parsed)[1]


def selective(rules: tuple[Rule, ...]) -> dict[str, Query]:
    """Query of each rule whose candidates the index can tell."""
    found = {rule.kind: trigram_query(rule.regex) for rule in rules}
    return {kind: query for kind, query in found.items() if query != ANYWHERE}


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams that the rules' queries name; their place is their bit."""
    return sorted({t for query in selective(rules).values() for alternative in query for t in alternative})


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """trigram, doc_id: postings over the lower-cased text."""
    lowered = F.lower(whole(F.col(text_col)))
    present = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in vocabulary(rules)]))
    return (
        docs.select(F.col(id_col).alias("doc_id"), lowered.alias("lowered"))
        .select("doc_id", F.explode(present).alias("trigram"))
        .select("trigram", "doc_id")
    )


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds: rules whose trigram query the document's postings fulfil."""
    bits = {t: i for i, t in enumerate(vocabulary(rules))}
    words = -(-len(bits) // 60)
    number = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])[F.col("trigram")]
    sets = index.withColumn("bit", number).groupBy("doc_id").agg(
        *[
            F.bit_or(F.when(F.floor(F.col("bit") / 60) == w, F.expr(f"shiftleft(1L, bit % 60)")).otherwise(0)).alias(f"set{w}")
            for w in range(words)
        ]
    )

    def holds(alternative: frozenset[str]) -> Column:
        masks = [0] * words
        for t in alternative:
            masks[bits[t] // 60] |= 1 << bits[t] % 60
        return reduce(
            lambda a, b: a & b,
            [F.col(f"set{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(masks) if m],
        )

    kinds = [
        F.when(reduce(lambda a, b: a | b, [holds(alternative) for alternative in sorted(query, key=sorted)]), F.lit(kind))
        for kind, query in selective(rules).items()
    ]
    return sets.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


SPAN = "struct<start:int,order:int,kind:string,end:int>"
BLOCK = 256


def with_spans(df: DataFrame, allowed: Column, rule: Rule, order: int, name: str) -> DataFrame:
    """``df`` (with ``text``) and an array column of the rule's spans (start, order, kind, end).

    Matches and the pieces between them alternate, so their lengths add up to positions. They
    are added up within blocks first and blocks moved to their place then. Every array that a
    lambda reads is a column by then, so that it is not made again for each of its elements.
    """
    text, regex = F.col("text"), F.lit(rule.regex)
    hit = F.coalesce(allowed, F.lit(False)) & text.rlike(rule.regex)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    deciding = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(found.alias("match"), deciding.alias("deciding"), F.split(text, rule.regex, -1).alias("gap"))
    steps = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z: F.struct(
            F.length(z["gap"]).alias("gap"), F.length(z["match"]).alias("size"), F.length(z["deciding"]).alias("deciding")
        ),
    )
    df = df.withColumn("__steps", F.when(hit, steps))
    n_blocks = F.ceil(F.size("__steps") / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice("__steps", b * BLOCK + 1, BLOCK))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        end = start + s["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(s["deciding"] >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    folded = F.transform(blocks, lambda block: F.aggregate(block, start, step))
    df = df.withColumn("__blocks", F.when(F.size("__steps") > 0, folded))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    offsets = F.aggregate(
        "__blocks",
        begin,
        lambda state, block: F.struct(
            (state["at"] + block["at"]).alias("at"), F.array_append(state["before"], state["at"]).alias("before")
        ),
    )["before"]
    moved = F.zip_with(
        "__blocks",
        offsets,
        lambda block, before: F.transform(
            block["spans"],
            lambda s: F.struct(
                (s["start"] + before).alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), (s["end"] + before).alias("end")
            ),
        ),
    )
    return df.withColumn(name, F.coalesce(F.flatten(moved), none)).drop("__steps", "__blocks")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (start, order, kind, end) sorted by start, then kind."""
    chosen = candidates(build_index(docs, rules, id_col, text_col), rules).withColumnRenamed("doc_id", "candidate_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    joined = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["candidate_id"]), "left")
    known, columns = selective(rules), []
    for order, rule in enumerate(rules):
        allowed = F.array_contains("kinds", rule.kind) if rule.kind in known else F.lit(True)
        columns.append(f"__spans{order}")
        joined = with_spans(joined, allowed, rule, order, columns[-1])
    return joined.select("doc_id", F.sort_array(F.concat(*columns)).alias("spans"))


def listing(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
