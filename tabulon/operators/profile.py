"""Column profiles: counts of values, kinds, missing cells and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.expressions import nan_to_null, quoted
from tabulon.operators.columns import numeric_columns
from tabulon.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _stacked(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """One output row per struct in ``rows`` for every input row."""
    return df.select(F.inline(F.array(*rows)))


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """(column, value) with a row per cell, values as text."""
    names = list(columns or df.columns)
    text = df.select(*[quoted(c).cast("string").alias(c) for c in names])
    return text.unpivot([], [quoted(c) for c in names], "column", "value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) with values as text and nulls left out, all
    columns in one job."""
    return (
        _cells(df, columns).filter("value is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column, the smallest of equally frequent ones.

    ``mode`` would hold all distinct values of a column in one buffer; the
    counted values are reduced instead.
    """
    # numbers compare as numbers although they were counted as text
    number = F.when(F.col("column").isin(*numeric_columns(df)), F.col("value").try_cast("double"))
    best = F.min(F.struct((-F.col("count")).alias("rank"), number.alias("number"), "value"))
    return (
        value_counts(df, columns).groupBy("column").agg(best.alias("best"))
        .select("column", F.col("best.value").alias("mode"), (-F.col("best.rank")).alias("count"))
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per number column;
    a column without values has count 0."""
    names = list(columns or numeric_columns(df))
    found = exact_quantiles(df, names, QUARTILES, moments=True)
    wanted = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return wanted.join(found, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", "min", *QUARTILES, "max"
    )


def column_info(df: DataFrame) -> DataFrame:
    """Position, type, non-null and null count per column, from one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
            F.col(f"c{i}").alias("non_null"), (F.col("n") - F.col(f"c{i}")).alias("missing"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return _stacked(counts, rows)


def missing_counts(df: DataFrame) -> DataFrame:
    return column_info(df).select("column", "missing")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, nulls being equal."""
    repeats = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return repeats.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def kind_census(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many cells of each column read as int, float, text or null.

    For tables that arrive as text; typed columns are judged by their text.
    """
    value = F.col("value")
    kind = (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(value.rlike(r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("text")
    )
    return (
        _cells(df, columns).groupBy("column", kind.alias("kind")).agg(F.count(F.lit(1)).alias("count"))
    )


def column_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    sums = df.agg(*[F.sum(quoted(c)).alias(c) for c in columns])
    return _stacked(
        sums, [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("sum")) for c in columns]
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair, over the rows where both are
    present. A column that is constant there has no correlation (null), also with itself.

    Each row becomes one vector of its present values, their squares and marks of presence;
    one pass sums the vectors' products into a single small matrix, which holds the
    counts, sums and products of every pair. Values are first shifted by the column's mean
    and scaled by its deviation, so that no digits are lost.
    """
    names = list(columns or numeric_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    numbers = df.select(*[nan_to_null(quoted(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    k = len(names)
    shape = numbers.agg(*[F.avg(f"x{i}") for i in range(k)], *[F.stddev_pop(f"x{i}") for i in range(k)]).first()
    centred = [(F.col(f"x{i}") - float(shape[i] or 0.0)) / float(shape[k + i] or 1.0) for i in range(k)]
    parts = [F.coalesce(v, F.lit(0.0)) for v in centred] + [F.coalesce(v * v, F.lit(0.0)) for v in centred]
    parts += [F.col(f"x{i}").isNotNull().cast("double") for i in range(k)]
    vectors = numbers.select(array_to_vector(F.array(*parts)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    values, squares, marks = (slice(at * k, (at + 1) * k) for at in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        n = gram[marks, marks]
        mean, square = gram[values, marks] / n, gram[squares, marks] / n  # of the row's column where the other is present
        spread = square - mean**2
        # rounding leaves a trace of spread in a constant column
        varies = spread > 1e-12 * np.maximum(square, 1e-300)
        r = (gram[values, values] / n - mean * mean.T) / np.sqrt(spread * spread.T)
    r = np.where(varies & varies.T, np.clip(r, -1.0, 1.0), np.nan)
    r[np.diag_indices(k)] = np.where(np.isnan(np.diag(r)), np.nan, 1.0)
    cells = [(x, y, None if np.isnan(r[i, j]) else float(r[i, j])) for i, x in enumerate(names) for j, y in enumerate(names)]
    return df.sparkSession.createDataFrame(cells, "x string, y string, r double")


def count_table(df: DataFrame, x: str, hue: str) -> DataFrame:
    """Rows per pair of categories, pairs with a null left out."""
    return (
        df.filter(quoted(x).isNotNull() & quoted(hue).isNotNull())
        .groupBy(quoted(x), quoted(hue)).agg(F.count(F.lit(1)).alias("count"))
    )


def cross_table(df: DataFrame, x: str, hue: str, values: Sequence | None = None) -> DataFrame:
    """The count table in wide form, a column per value of ``hue``: those given,
    or all that occur, whose names the driver then holds."""
    if values is None:
        values = sorted(r[0] for r in df.select(quoted(hue)).filter(quoted(hue).isNotNull()).distinct().collect())
    return df.filter(quoted(x).isNotNull()).groupBy(quoted(x)).agg(
        *[F.count_if(quoted(hue) == v).alias(str(v)) for v in values]
    )
