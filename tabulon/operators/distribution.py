"""Tables behind the usual distribution plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.expressions import nan_to_null, quoted
from tabulon.operators.bounded import join_small, pinned
from tabulon.operators.quantiles import exact_quantiles


def _numbers(df: DataFrame, column: str) -> DataFrame:
    value = nan_to_null(quoted(column).cast("double"))
    return df.select(value.alias("x")).filter(F.col("x").isNotNull())


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and the number
    of values beyond them, per non-null group."""
    rows = df.filter(quoted(group).isNotNull()).select(quoted(group), quoted(value))
    quartiles = pinned(
        exact_quantiles(rows, [value], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[group])
        .drop("column")
        .withColumn("fence", 1.5 * (F.col("q3") - F.col("q1")))
    )
    x = F.col("x")
    spread = join_small(
        rows.select(quoted(group), nan_to_null(quoted(value).cast("double")).alias("x")).filter("x is not null"),
        quartiles, [group],
    )
    within = x.between(F.col("q1") - F.col("fence"), F.col("q3") + F.col("fence"))
    ends = spread.groupBy(quoted(group)).agg(
        F.min(F.when(within, x)).alias("lowest"),
        F.max(F.when(within, x)).alias("highest"),
        F.count_if(~within).alias("outliers"),
    )
    return join_small(ends, quartiles, [group]).select(
        quoted(group), "n", "q1", "median", "q3",
        F.least("lowest", "q1").alias("whisker_low"),
        F.greatest("highest", "q3").alias("whisker_high"),
        "outliers",
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin (``bin``, ``low``, ``high``, ``count``).

    Bins are closed on the left, the last one on both sides; empty bins are
    present. A constant column gets a range of one around its value.
    """
    numbers = _numbers(df, column)
    low, high = numbers.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if low is None:
        return spark.range(0).selectExpr(
            "cast(id as int) bin", "cast(null as double) low", "cast(null as double) high", "id count"
        )
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins

    def edge(i):
        return F.when(i == bins, F.lit(high)).otherwise(i * F.lit(width) + F.lit(low))

    x = F.col("x")
    # division may land one bin off next to an edge, so the edges decide
    guess = F.least(F.floor((x - F.lit(low)) * F.lit(bins / (high - low))), F.lit(bins - 1)).cast("int")
    numbers = numbers.select("x", guess.alias("g"))
    g = F.col("g")
    index = F.when(x < edge(g), g - 1).when((x >= edge(g + 1)) & (g < bins - 1), g + 1).otherwise(g)
    counted = numbers.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counted), "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


# exp(-REACH ** 2 / 2) is below the smallest double.
REACH = 39.0


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density estimate at evenly spaced points from min to max, with
    the bandwidth n^(-1/5) times the sample deviation.

    Equal values are counted first. A value only meets the points within
    ``REACH`` bandwidths, since beyond them its kernel is exactly 0 in a double;
    each task sends at most one partial sum per point.
    """
    numbers = _numbers(df, column)
    low, high, deviation, n = numbers.agg(
        F.min("x"), F.max("x"), F.stddev_samp("x"), F.count("x")
    ).first()
    spark = df.sparkSession
    if not n or not deviation:
        return spark.range(0).selectExpr("cast(id as int) point", "0.0D x", "0.0D density")
    h = deviation * n ** -0.2
    step = (high - low) / (points - 1)
    reach = F.lit(REACH * h)
    first = F.greatest(F.ceil((F.col("x") - F.lit(low) - reach) / F.lit(step)), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("x") - F.lit(low) + reach) / F.lit(step)), F.lit(points - 1)).cast("int")
    spots = (
        numbers.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
        .select("x", "rows", F.explode(F.when(first <= last, F.sequence(first, last))).alias("point"))
    )
    at = F.col("point") * F.lit(step) + F.lit(low)
    z = (at - F.col("x")) / F.lit(h)
    mass = F.sum(F.col("rows") * F.exp(-z * z / 2))
    found = spots.groupBy("point").agg((mass / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(F.broadcast(found), "point", "left").select(
        "point", (F.col("point") * F.lit(step) + F.lit(low)).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))
