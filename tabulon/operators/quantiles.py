"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one buffer, which does
not hold for wide-ranging columns. Here a quantile sketch gives, per group, a
narrow bracket around each wanted rank. The second pass counts rows outside the
brackets as single totals and cuts each bracket into slices; slice totals show
which slice holds the rank, and only that slice is put in order. The result is
the exact order statistic, linearly interpolated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.expressions import nan_to_null, quoted
from tabulon.operators.bounded import join_small, pin

# Relative rank error of the sketch is 1 / ACCURACY, so a bracket holds about
# 8 / ACCURACY of a column, and a slice of it 1 / SLICES of that.
ACCURACY = 10_000
SLICES = 4_096
# Parts in which the sketches of a column are first brought together.
SALTS = 128

MOMENTS = ("mean", "std", "min", "max")


def long_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value) with a row per non-null number."""
    doubles = [nan_to_null(quoted(c).cast("double")).alias(c) for c in columns]
    wide = df.select(*[quoted(c).alias(f"by_{c}") for c in by], *doubles)
    keys = [f"by_{c}" for c in by]
    return (
        wide.unpivot(keys, list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .withColumnsRenamed(dict(zip(keys, by)))
    )


def _part_moments() -> list[Column]:
    return [
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]


def _merged_moments() -> list[Column]:
    """Moments of a group from those of its parts; ``std`` follows from ``parts``."""
    return [
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.collect_list(F.struct("n", "mean", "std")).alias("parts"),
    ]


def _deviation() -> Column:
    """Sample deviation of a group from at most ``SALTS`` parts: the spread within
    the parts plus that of their means, which stays accurate for large means."""
    def add(total, part):
        return total + part["n"] * (part["std"] ** 2 + (part["mean"] - F.col("mean")) ** 2)

    squares = F.aggregate("parts", F.lit(0.0), add)
    return F.sqrt(F.try_divide(squares, F.col("n") - 1))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    moments: bool = False,
    accuracy: int = ACCURACY,
    slices: int = SLICES,
) -> DataFrame:
    """One row per (by, column): ``n``, a column per named probability and, with
    ``moments``, also ``mean``, ``std``, ``min`` and ``max``.

    Groups of at most ``accuracy`` rows skip the bracket and are counted whole.
    """
    numbers = long_numbers(df, columns, by)
    keys, names, extra = [*by, "column"], list(probabilities), list(MOMENTS) if moments else []
    shares = [float(probabilities[n]) for n in names]
    each = range(len(shares))

    # First pass: the bracket of every wanted rank. The sketch is off by at most
    # n / accuracy ranks, so four times that on both sides is certain to hold it.
    # Sketches of all tasks would meet in one reducer per column, so they meet in
    # salted parts first: at most p * n_s rows of a part lie below its own lower
    # edge, hence at most p * n rows of the group below the least of these edges.
    slack = 4.0 / accuracy
    asked = [max(p - slack, 0.0) for p in shares] + [min(p + slack, 1.0) for p in shares]
    parts = numbers.withColumn("part", F.spark_partition_id() % SALTS).groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", asked, accuracy).alias("edges"),
        *(_part_moments() if moments else []),
    )
    sketch = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.min(F.col("edges")[i]).alias(f"lo{i}") for i in each],
        *[F.max(F.col("edges")[len(shares) + i]).alias(f"hi{i}") for i in each],
        *(_merged_moments() if moments else []),
    )
    if moments:
        sketch = sketch.withColumn("std", _deviation())
    large = F.col("n") > accuracy
    brackets, small = pin(
        sketch.select(
            *keys, "n", *extra,
            *[F.when(large, F.col(f"lo{i}")).otherwise(float("-inf")).alias(f"lo{i}") for i in each],
            *[F.when(large, F.col(f"hi{i}")).otherwise(float("inf")).alias(f"hi{i}") for i in each],
        )
    )

    # Second pass: place each value by the number of brackets that end below it,
    # whether it lies in one, and the slice of that bracket. Values between the
    # brackets are only counted.
    value = F.col("value")
    ended, inside, slice_ = F.lit(0), F.lit(False), F.lit(0)
    for i in reversed(each):
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        within = value.between(low, high)
        ended = ended + (value > high).cast("int")
        inside = inside | within
        part = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
        slice_ = F.when(within, F.when(large, F.floor(part * slices)).otherwise(0)).otherwise(slice_)
    place = [*keys, "ended", "inside", "slice"]
    edges = brackets.select(*keys, "n", *[f"lo{i}" for i in each], *[f"hi{i}" for i in each])
    counted = (
        join_small(numbers, edges, keys)
        .select(
            *keys, ended.alias("ended"), inside.alias("inside"), slice_.alias("slice"),
            F.when(inside, value).alias("value"),
        )
        .groupBy(*place, "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )

    # The slices that hold a wanted rank, from the slice totals; then the value
    # at that rank, from the values of those slices alone.
    upto, rows = F.col("upto"), F.col("rows")
    ranks = []
    for share in shares:
        position = (F.col("n") - 1) * F.lit(share)
        ranks += [F.floor(position), F.ceil(position)]

    def hits(rank):
        return (rank < upto) & (rank >= upto - rows)

    any_hit = F.lit(False)
    for rank in ranks:
        any_hit = any_hit | hits(rank)
    running = (
        Window.partitionBy(*keys).orderBy("ended", "inside", "slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = brackets.select(*keys, "n", *extra)
    slices_hit = join_small(
        counted.groupBy(*place).agg(F.sum("rows").alias("rows")).withColumn("upto", F.sum("rows").over(running)),
        totals, keys,
    ).filter(any_hit).select(*place, "n", *extra, (upto - rows).alias("before"))
    in_slice = (
        Window.partitionBy(*place).orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = join_small(counted, F.broadcast(slices_hit) if small else slices_hit, place).withColumn(
        "upto", F.col("before") + F.sum("rows").over(in_slice)
    )
    missed = F.raise_error(F.lit("rank outside its bracket; raise accuracy")).cast("double")
    at = [F.max(F.when(hits(rank), F.when(F.col("inside"), value).otherwise(missed))) for rank in ranks]
    found = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(a).alias(a) for a in extra],
        *[expr.alias(f"r{i}") for i, expr in enumerate(at)],
    )
    out = []
    for i, (name, share) in enumerate(zip(names, shares)):
        position = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, "n", *extra, *out)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, median) of each numeric column that has a value."""
    return exact_quantiles(df, columns, {"median": 0.5})
