"""Benchmark decontamination through a distributed positional inverted index.

The index stores postings (term, document, position) of the terms that a search can start
from: for every window of a benchmark item its rarest term, by counts over the whole
corpus. A posting carries the words around its position, which are the neighbouring
postings of the same document with their offsets already adjusted. A search therefore
joins windows to postings on the rarest term alone and intersects the other terms in place:
first the second rarest at its offset, then the exact words. No other posting is moved,
and a word as frequent as "the" is never shuffled unless a window has nothing rarer.

Only the windows' terms can grow a table here: they are broadcast after a count, and joined
by a shuffle when they are more than that bound.

Null text or a text without words: no words, no hit. Null ids are kept and matched as one
id. Rows that repeat an id with the same text get the same result each; with another text
they are separate documents. An empty benchmark: nothing is hit. Item ids may repeat; they
count once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import broadcast_if_small, fresh, lower_ascii, same, text_key, whole
from riskgraph.session import materialize

WINDOW = 10
# What lies between words; letters of either case belong to words here.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Pieces between gaps; the first or the last is empty where the text has a gap there."""
    return F.split(whole(text), GAPS, -1)


def count_words(pieces: Column) -> Column:
    edges = (F.element_at(pieces, 1) == "").cast("long") + (F.element_at(pieces, -1) == "").cast("long")
    return F.greatest(F.lit(0).cast("long"), F.size(pieces).cast("long") - edges)


def benchmark_windows(
    benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """item_id, words: every distinct window; a shorter item is one window."""
    words = F.filter(split_words(lower_ascii(F.col(text_col))), lambda w: w != "")
    items = benchmark.select(F.col(item_col).alias("item_id"), words.alias("all_words")).filter(
        F.size("all_words") > 0
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all_words") - (window - 1)))
    return (
        items.withColumn("start", F.explode(starts))
        .select("item_id", F.slice("all_words", F.col("start"), window).alias("words"))
        .distinct()
    )


def corpus_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        split_words(F.col(text_col)).alias("pieces"),
    )


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each given term occurs in the whole corpus."""
    found = words.select(F.explode("pieces").alias("word")).select(F.lower("word").alias("term"))
    return (
        found.join(broadcast_if_small(terms), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def search_plan(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """term, candidates: windows by their rarest term, with its offset and the second rarest.

    A window with a term that the corpus lacks cannot occur and is left out.
    """
    terms = windows.select("item_id", "words", F.posexplode("words").alias("offset", "word")).select(
        "item_id", "words", "offset", F.lower("word").alias("term")
    )
    ranked = (
        terms.join(broadcast_if_small(counts), "term", "left")
        .groupBy("item_id", "words")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("by_count"))
        .filter(F.col("by_count")[0]["n"] > 0)
    )
    second = F.coalesce(F.get("by_count", F.lit(1)), F.col("by_count")[0])
    return (
        ranked.select(
            F.col("by_count")[0]["term"].alias("term"),
            F.struct(
                F.col("by_count")[0]["offset"].alias("offset"),
                second["offset"].alias("second_offset"),
                second["term"].alias("second_term"),
                "item_id",
                "words",
            ).alias("candidate"),
        )
        .groupBy("term")
        .agg(F.collect_list("candidate").alias("candidates"))
    )


def build_index(words: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """term, doc_id, text_key, position, first, around: postings with the words around them.

    ``first`` is the position of the first word in ``around``, which reaches ``reach`` words
    to either side.
    """
    lead = (F.element_at("pieces", 1) == "").cast("int")
    postings = (
        words.select("doc_id", "text_key", "pieces", lead.alias("lead"), F.posexplode("pieces").alias("at", "word"))
        .withColumn("term", F.lower("word"))
        .join(broadcast_if_small(terms), "term", "left_semi")
    )
    first = F.greatest(F.lit(0), F.col("at") - reach)
    around = F.slice("pieces", first + 1, F.col("at") - first + 1 + reach)
    return postings.select(
        "term", "doc_id", "text_key",
        (F.col("at") - F.col("lead")).alias("position"),
        (first - F.col("lead")).alias("first"),
        around.alias("around"),
    )


def phrase_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, text_key, matches: per posting the windows that occur there exactly."""

    def at(candidate: Column) -> Column:
        """Place of the window's first word in ``around``, from 0."""
        return F.col("position") - candidate["offset"] - F.col("first")

    def occurs(candidate: Column) -> Column:
        place = at(candidate)
        near = F.lower(F.get("around", place + candidate["second_offset"])) == candidate["second_term"]
        phrase = F.transform(F.slice("around", place + 1, F.size(candidate["words"])), lower_ascii)
        return F.when((place >= 0) & F.coalesce(near, F.lit(False)), phrase == candidate["words"]).otherwise(False)

    found = F.transform(
        F.filter("candidates", occurs),
        lambda c: F.struct(
            c["item_id"].alias("item_id"),
            (F.col("position") - c["offset"]).alias("start"),
            F.size(c["words"]).alias("length"),
        ),
    )
    return (
        index.join(broadcast_if_small(plan), "term")
        .select("doc_id", "text_key", found.alias("matches"))
        .filter(F.size("matches") > 0)
    )


def proximity_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, text_key, position, items: windows whose terms all lie around a posting, in any order."""
    lowered = F.transform("around", lower_ascii)
    near = F.filter("candidates", lambda c: F.size(F.array_except(c["words"], F.col("lowered"))) == 0)
    return (
        index.join(broadcast_if_small(plan), "term")
        .withColumn("lowered", lowered)
        .select(
            "doc_id", "text_key", "position",
            F.array_distinct(F.transform(near, lambda c: c["item_id"])).alias("items"),
        )
        .filter(F.size("items") > 0)
    )


def prepare(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, slop=0):
    """The written index and the search plan for it; ``slop`` widens the stored surroundings."""
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    words = corpus_words(docs, id_col, text_col)
    terms = windows.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct()
    plan = materialize(search_plan(windows, materialize(term_counts(words, terms), "term-counts")), "plan")
    index = materialize(build_index(words, plan.select("term"), window - 1 + slop), "postings")
    return index, plan


def covered(matches: DataFrame) -> DataFrame:
    """doc_id, text_key, n_hit, items: words inside any match, and the items that match.

    Matches repeat only where rows do, so they are told apart as numbers and strings, which
    are hashed, and never as pairs of structs, however many one long text has.
    """
    positions = F.flatten(
        F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1))
    )
    return (
        matches.groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_list("matches")).alias("found"))
        .select(
            "doc_id", "text_key",
            F.size(F.array_distinct(positions)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.transform("found", lambda m: m["item_id"].cast("string")))).alias("items"),
        )
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items, contaminated."""
    index, plan = prepare(docs, benchmark, id_col, text_col, window)
    hits = covered(phrase_matches(index, plan)).withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    rows = corpus_words(docs, id_col, text_col).select("doc_id", "text_key", count_words(F.col("pieces")).alias("n_words"))
    joined = rows.join(hits, same(rows, hits, {"doc_id": "hit_id", "text_key": "hit_key"}), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; all columns stay."""
    index, plan = prepare(docs, benchmark, id_col, text_col, window)
    key, hit_id, hit_key = fresh(docs, "key", "hit_id", "hit_key")
    hits = phrase_matches(index, plan).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct()
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    return keyed.join(hits, same(keyed, hits, {id_col: hit_id, key: hit_key}), "left_anti").drop(key)
