"""Statistics of very many columns: the cells of a row as one array, one group per column.

An aggregation with several expressions for each of hundreds of columns leaves generated code
and is planned for seconds. Here the feature columns of a row become one array, the array one
cell per feature, and a single short aggregation keyed on the feature's number folds the cells
in each task first. So a shuffle carries one row per task and feature, whatever the number of
rows, and the plan stays the same size for 20 and for 600 columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.labels import column

PLACE, VALUE = "__place", "__value"


def as_double(c: Column) -> Column:
    return c.cast("double")


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def cells(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), of: Callable[[Column], Column] = as_double
) -> DataFrame:
    """``keep``, number of the feature, and ``of`` its value: a row per row and feature."""
    values = F.array(*[of(column(f)) for f in features])
    return df.select(*[column(c) for c in keep], F.posexplode(values).alias(PLACE, VALUE))


def name_of(features: Sequence[str], place: str = PLACE) -> Column:
    return F.get(F.array(*map(F.lit, features)), F.col(place))


def per_feature(
    df: DataFrame,
    features: Sequence[str],
    aggregates: Sequence[Column],
    keep: Sequence[str] = (),
    of: Callable[[Column], Column] = as_double,
) -> DataFrame:
    """``__place, feature`` and the aggregates over ``__value``: a row per feature, of an empty table too."""
    folded = cells(df, features, keep, of).groupBy(PLACE).agg(*aggregates)
    # One row per named feature.
    places = df.sparkSession.range(len(features)).select(F.col("id").cast("int").alias(PLACE))
    return places.join(F.broadcast(folded), PLACE, "left").withColumn("feature", name_of(features))


def moments(df: DataFrame, features: Sequence[str], of: Callable[[Column], Column] = without_nan) -> DataFrame:
    """``__place, feature, mean, sd, n`` of the cells that are not NULL."""
    value = F.col(VALUE)
    aggregates = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n")]
    return per_feature(df, features, aggregates, of=of).withColumn("n", F.coalesce("n", F.lit(0)))
