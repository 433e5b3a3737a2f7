"""URL rules as a sort-merge range join.

The canonical key of a host is its labels reversed, each followed by a dot: "org.example."
for example.org. The host and all its subdomains are then the interval of keys that start
with it, and intervals of different hosts are nested or apart. URLs are sorted by key in
blocks of similar size; every block also gets the rules whose interval meets it. One sweep
over a sorted block keeps the stack of hosts whose interval is open; each stack entry knows
its paths, and the longest rule (host and path together) among them wins, the longer host
on a tie.

Block borders come from a sample of the keys and only balance the work. The last part of
the sort key is a hash of the id, so a block may end inside a single host or URL that a
third of all pages share. A rule is copied only to the blocks that its interval meets. A
task holds the rules of one host chain at a time.

A null URL or one without "://" has an empty host and path, which no rule fits. A null id is
kept. Repeated rows are judged one by one. Without rules all get the default verdict. Other
columns are ignored. Of rules with equal host and path, block wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.columns import lower_ascii, whole

PAGES_A_BLOCK = 200_000
SAMPLED_A_BLOCK = 50
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(whole(url), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), "://[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def borders(keys: DataFrame, blocks: int) -> list[tuple[str, int]]:
    """Up to ``blocks`` - 1 cut points (key, salt) from a sample of bounded size."""
    total = keys.count()
    if blocks < 2 or not total:
        return []
    share = min(1.0, SAMPLED_A_BLOCK * blocks / total)
    seen = sorted(map(tuple, keys.sample(share, seed=7).collect())) or [("", 0)]
    return sorted({seen[i * len(seen) // blocks] for i in range(1, blocks)})


def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted block: rules open and close on a stack, every URL takes its longest rule."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []
    for batch in rows:
        out = []
        for key, is_url, page_id, host, path, verdict in zip(
            batch.key, batch.is_url, batch.page_id, batch.host, batch.path, batch.verdict, strict=True
        ):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                paths = stack[-1][1]
                if paths.get(path) != "block":
                    paths[path] = verdict
                if len(path) not in stack[-1][2]:
                    stack[-1][2].append(len(path))
                continue
            best = (-1, -1, None, DEFAULT)
            for at, paths, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (found := paths.get(path[:n])) is not None:
                        name = ".".join(reversed(at[:-1].split("."))) + path[:n]
                        best = max(best, (len(name), len(at), name, found), key=lambda b: b[:2])
            out.append((page_id, host, path, best[2], best[3]))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``rules`` has host, path and verdict (allow or block).
    """
    spark = pages.sparkSession
    host = host_of(F.col(url_col))
    urls = pages.select(
        canonical(host).alias("key"),
        F.xxhash64(F.col(id_col), F.col(url_col)).alias("salt"),
        F.col(id_col).cast("long").alias("page_id"),
        host.alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = urls.select("key", "salt")
    wanted = blocks or max(least, keys.count() // PAGES_A_BLOCK)
    cuts = borders(keys, wanted)

    @F.pandas_udf("int")
    def block_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, pair) for pair in zip(key, salt, strict=True)], dtype="int32")

    # The largest salt and, for ends, a character that no key contains after its prefix.
    lowest, highest = F.lit(-(2**63)), F.lit(2**63 - 1)
    clean = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    intervals = clean.select(
        canonical(lower_ascii(F.col("host"))).alias("key"), "path", "verdict"
    ).filter(F.col("key") != "").distinct()
    opened = intervals.withColumn("from", block_of("key", lowest)).withColumn(
        "to", block_of(F.concat("key", F.lit("\U0010ffff")), highest)
    )
    copies = opened.select(
        F.explode(F.sequence("from", "to")).alias("block"), "key", F.lit(False).alias("is_url"),
        F.lit(0).cast("long").alias("salt"), F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("host"), "path", "verdict",
    )
    dealt = urls.select(
        block_of("key", "salt").alias("block"), "key", F.lit(True).alias("is_url"),
        "salt", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    return (
        dealt.unionByName(copies)
        .repartition(wanted, "block")
        .sortWithinPartitions("block", "key", "is_url", "salt")
        .select("key", "is_url", "page_id", "host", "path", "verdict")
        .mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
    )
