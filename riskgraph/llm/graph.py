"""Connected components of an edge table, by alternating star contractions.

Every round replaces edges by ones that point to smaller neighbours, first among larger
neighbours, then among smaller ones, until every node points at the smallest of its
component. Rounds grow with the logarithm of the longest path. Each round is written to the
shared folder, which cuts the lineage and survives lost executors. A node with very many
edges is folded on the map side where its minimum is taken, and split by adaptive execution
where the minimum is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.session import materialize


def _point_to(edges: DataFrame) -> DataFrame:
    """Edges (a, b): every b hangs on the smallest of a and its b's."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    return edges.join(least, edges["a"] == least["of"]).select(
        "a", "b", F.least("a", "least").alias("least")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    hung = _point_to(both).filter(F.col("b") > F.col("a"))
    return hung.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _point_to(edges)
    moved = hung.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = hung.select("a", F.col("least").alias("b"))
    return moved.union(own).filter("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of ``edges`` (a, b: long).

    Loops and repeated edges do no harm; rows with a null end are left out.
    """
    directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNull() | F.col("b").isNull()).alias("open"))
    current = materialize(directed.filter("not open and a > b").select("a", "b").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        seen, mark = mark, _mark(current)
        if mark == seen:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
