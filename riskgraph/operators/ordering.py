"""Exact ranks and running totals over a whole table, without a one-task window.

A window with no (or a hot) partition key sorts all its rows in one task. Here rows are
range-partitioned on the full sort key instead: Spark samples the key, so every block holds
a similar share even when one score covers a third of the rows, as long as the sort key
ends in something that tells tied rows apart. Blocks are frozen in a written table (a
block number must not change when a task is rerun), each block is summed, and the offset
of every block is broadcast. That offset table has at most one row per block and group
border, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.session import materialize

BLOCK = "__block"
POSITION = "__position"


def frozen_blocks(df: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Sorted range blocks of ``df`` with their block number and the position inside."""
    keys = [F.col(name).asc() for name in group] + list(order)
    block = F.spark_partition_id()
    return materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(BLOCK, block)
        # The low 33 bits of the generated id count the rows of one partition.
        .withColumn(
            POSITION,
            F.monotonically_increasing_id() - F.shiftleft(F.col(BLOCK).cast("long"), 33),
        ),
        "blocks",
    )


def _before(group: Sequence[str]):
    """All blocks of the group that come before this one (rows: one per block)."""
    return Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _with_offsets(blocks: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Blocks with their offset row; a NULL group is a group like any other."""
    named = offsets.withColumnsRenamed({c: f"__of_{c}" for c in (*group, BLOCK)})
    condition = blocks[BLOCK] == named[f"__of_{BLOCK}"]
    for c in group:
        condition = condition & blocks[c].eqNullSafe(named[f"__of_{c}"])
    return blocks.join(F.broadcast(named), condition).drop(*[f"__of_{c}" for c in (*group, BLOCK)])


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Row number 1..n per group, and the group size when ``total`` names a column.

    ``group`` holds few values (models, labels, features); ``order`` must be unique within
    a group for the result to be repeatable. A NULL group is ranked by itself.
    """
    blocks = frozen_blocks(df, order, group)
    spans = blocks.groupBy(*group, BLOCK).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(POSITION).alias("__first")
    )
    offsets = spans.select(
        *group,
        BLOCK,
        (F.coalesce(F.sum("__rows").over(_before(group)), F.lit(0)) + 1 - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(Window.partitionBy(*group)).alias("__total"),
    )
    ranked = _with_offsets(blocks, offsets, group).withColumn(
        rank, F.col(POSITION) + F.col("__shift")
    )
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop(BLOCK, POSITION, "__shift", "__total")


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` per group in ``order``."""
    blocks = frozen_blocks(df, order, group)
    spans = blocks.groupBy(*group, BLOCK).agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    offsets = spans.select(
        *group,
        BLOCK,
        *[
            F.coalesce(F.sum(f"__{new}").over(_before(group)), F.lit(0)).alias(f"__{new}")
            for new in sums
        ],
    )
    inside = (
        Window.partitionBy(*group, BLOCK)
        .orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _with_offsets(blocks, offsets, group)
    for new, column in sums.items():
        joined = joined.withColumn(new, F.sum(column).over(inside) + F.col(f"__{new}"))
    return joined.drop(BLOCK, POSITION, *[f"__{new}" for new in sums])
