"""The registered queries of the text operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import (
    chats, collocations, decontaminate, divergence, lines, packing, periods, personal, quality, secret_scan, simhash, substrings, url_rules,
)
from riskgraph.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The rules of the URL query (fixed values): host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id",
        count_of("assign").alias("n_assign"),
        count_of("access").alias("n_access"),
        count_of("hex").alias("n_hex"),
        F.sha2(secret_scan.listing(base), 256).alias("base_sha256"),
        secret_scan.listing(F.col("spans")).alias("spans"),
    )


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.scores(docs, table(spark, folder, "labels"))


@query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in personal.BASE_KINDS],
        F.sha2(personal.listing(base), 256).alias("base_sha256"),
        personal.listing(F.col("spans")).alias("spans"),
    )


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs).drop("class_distance", "common_distance")


@query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages").select("page_id", "url"), rules)


def tokenizer_definition(name: str = TOKENIZER) -> str:
    """JSON of an installed public tokenizer, read on the driver and shipped to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, tokenizer_definition(), ids=False)


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    kept = lines.remove_boilerplate(docs, n_lines="n_lines", n_removed="n_removed")
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("doc_id", "text", "lang"))


SPACES = r"[ \t-\r]+"


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by the checksum of their id, becomes periodic from some word on."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    start = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - F.col("at")) / (3 + F.col("g") % 8))).cast("int")
    chosen = (F.col("h") % 10 == 0) & (F.col("text") != "")
    copies = F.ceil((n - F.col("at")) / F.col("period")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("at") + 1, F.col("period")), copies)), F.lit(1), n - F.col("at"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("at")), again), " ")
    parts = (
        docs.withColumn("h", number).withColumn("g", g).withColumn("words", F.when(chosen, words))
        .withColumn("at", F.when(n > 0, start)).withColumn("period", F.when(n > 0, period))
    )
    return parts.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_periods(table(spark, folder, "documents").select("doc_id", "text"))
    found = periods.find_runs(docs.select("doc_id", "text")).drop("text")

    def better(best: Column, run: Column) -> Column:
        greater = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(greater, run).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# A conversation made of control strings that every run formats beside the table (fixed values).
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"),
        F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    done = chats.formatted(chats.streamed(rows.union(control)))
    read = done.withColumn("turns", chats.turns_of(F.col("formatted"))).withColumn("loss", chats.loss_text(F.col("segments")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
