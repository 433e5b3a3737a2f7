"""Cross-site boilerplate lines, found by the number of distinct sites that show a line.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge in an ordinary
aggregation with a map-side part, so a line that a third of all documents share is one row
per task before anything is shuffled. Where a sketch's estimate lies near the threshold the
exact distinct count decides. A line on too many sites is removed everywhere but at its
first place, so that its content stays in the corpus once.

Lines are the pieces between line feeds, compared without spaces, tabs and carriage returns
at their ends; blank lines stay. Null text counts as empty, a null site as a site of its
own. The first place is the smallest (id, text key, line number), nulls first. Rows that
repeat an id with the same text are one document and get the same result; with another
text they are separate documents. Other columns are kept and never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import fresh, same, text_key, whole
from riskgraph.session import materialize

MIN_SITES = 5
LG_K = 10
SIGMAS = 5


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """h1, h2, site, doc_id, text_key, line: a row per line that is not blank, without its text."""
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"),
        F.posexplode(F.split(whole(F.col(text_col)), "\n", -1)).alias("line", "content"),
    ).withColumn("content", F.trim("content", F.lit(" \t\r")))
    return lines.filter(F.col("content") != "").select(
        F.xxhash64("content").alias("h1"),
        F.xxhash64(F.lit("line"), "content").alias("h2"),
        "site", "doc_id", "text_key", "line",
    )


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, first: the lines on at least ``min_sites`` sites, with their first place.

    The estimate decides alone only when it lies more than SIGMAS standard errors from the
    threshold; the others are counted exactly.
    """
    error = SIGMAS * 1.04 / math.sqrt(2**lg_k)
    sketched = materialize(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("site", lg_k).alias("sites"),
            F.min(F.struct("doc_id", "text_key", "line")).alias("first"),
        )
        .select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .filter(F.col("estimate") >= math.floor(min_sites * (1 - error))),
        "line-sketches",
    )
    certain = sketched.filter(F.col("estimate") > math.ceil(min_sites * (1 + error)))
    near = sketched.filter(F.col("estimate") <= math.ceil(min_sites * (1 + error)))
    counted = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites)
    )
    return certain.select("h1", "h2", "first").union(
        near.join(counted, ["h1", "h2"]).select("h1", "h2", "first")
    )


def removals(lines: DataFrame, widespread: DataFrame) -> DataFrame:
    """doc_id, text_key, lines: sorted line numbers to remove, for documents that have any."""
    here = F.struct("doc_id", "text_key", "line")
    return (
        lines.join(widespread, ["h1", "h2"])
        .filter(~here.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def kept_lines(lines: str, removed: str) -> Column:
    """The lines between the removed numbers. Both are columns already, so each line is copied once."""

    def stretch(i: Column) -> Column:
        after = F.coalesce(F.when(i > 0, F.get(removed, i - 1)) + 1, F.lit(0))
        return F.slice(lines, after + 1, F.coalesce(F.get(removed, i), F.size(lines)) - after)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), stretch))


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    n_lines: str | None = None,
    n_removed: str | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text; counts where columns are named."""
    lines = materialize(line_table(docs, id_col, text_col, site_col), "lines")
    key, cut_id, cut_key, gone, pieces = fresh(docs, "key", "cut_id", "cut_key", "gone", "pieces")
    cut = removals(lines, materialize(spread(lines, min_sites), "widespread")).select(
        F.col("doc_id").alias(cut_id), F.col("text_key").alias(cut_key), F.col("lines").alias(gone)
    )
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = keyed.join(cut, same(keyed, cut, {id_col: cut_id, key: cut_key}), "left")
    joined = joined.withColumn(pieces, F.split(whole(keyed[text_col]), "\n", -1))
    text = F.when(F.col(gone).isNull(), keyed[text_col]).otherwise(F.array_join(kept_lines(pieces, gone), "\n"))
    counts = []
    if n_lines:
        counts.append(F.size(pieces).cast("long").alias(n_lines))
    if n_removed:
        counts.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))
    return joined.select(*[text.alias(c) if c == text_col else keyed[c] for c in docs.columns], *counts)
