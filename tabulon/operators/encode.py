"""Category encodings with fitted levels that are reused on new rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import accumulate
from typing import ClassVar

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import (
    AGE_EDGES, AGE_LABELS, DIET_ORDER, mapped, ordinal_code, quoted, right_closed_bin,
)
from tabulon.operators.bounded import SMALL_ROWS, join_small, numbered
from tabulon.operators.columns import drop_null, numeric_columns, text_columns
from tabulon.operators.quantiles import medians


def age_group(df: DataFrame, column: str = "age", out: str = "age_group") -> DataFrame:
    return df.withColumn(out, right_closed_bin(quoted(column), AGE_EDGES, AGE_LABELS))


# --- index codes -----------------------------------------------------------

def frequency_index(df: DataFrame, columns: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """Index by falling frequency, ties alphabetical; null and unseen values
    get the index after the last level."""
    return fit_frequency_index(df, columns, suffix).transform(df)


def fit_frequency_index(df: DataFrame, columns: Sequence[str], suffix: str = "_idx"):
    return StringIndexer(
        inputCols=list(columns), outputCols=[c + suffix for c in columns], handleInvalid="keep"
    ).fit(df)


def frequency_coded(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same index as a join to the ranked levels, for columns with more
    levels than a fitted indexer should bring to the driver."""
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("level")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    codes = numbered(counts, [F.desc("rows"), F.asc("level")], "code").select(
        F.col("level").alias(column), F.col("code").cast("double").alias(out)
    )
    # null and unseen values follow the last level
    last = codes.agg(F.count(F.lit(1)).cast("double")).scalar()
    return join_small(df, codes, [column], "left").withColumn(out, F.coalesce(out, last))


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Vector of the columns in the given order; a null number is an error."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def assembled_array(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return assembled(df, columns, out).withColumn(out, vector_to_array(out))


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): observed levels coded densely in sorted order; null, when
    it occurs, takes the code after the last level."""
    distinct = df.select(quoted(column).alias("level")).distinct()
    return numbered(distinct, [F.asc_nulls_last("level")], "code")


def label_encoded(df: DataFrame, column: str, out: str) -> DataFrame:
    codes = level_codes(df, column).withColumnsRenamed({"level": column, "code": out})
    return join_small(df, codes, [column], "left")


def ordinal_encoded(
    df: DataFrame, column: str, order: Sequence[str], out: str, unknown: str = "error"
) -> DataFrame:
    return df.withColumn(out, ordinal_code(quoted(column), order, unknown))


# --- one-hot ---------------------------------------------------------------

def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted non-null levels per column, found in one job.

    Each level is going to be a column, so the driver holds their names; for
    columns with more levels than a table can have columns, declare the vector
    form (:func:`one_hot_vector`).
    """
    if not columns:
        return {}
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level")) for c in columns]
    distinct = df.select(F.inline(F.array(*cells))).filter("level is not null").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in distinct.collect():
        found[row["column"]].append(row["level"])
    return {c: sorted(levels) for c, levels in found.items()}


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    levels: Mapping[str, Sequence[str]] | None = None,
    drop_first: bool = False,
) -> DataFrame:
    """0/1 integer columns named ``column_level`` after the other columns; the
    source is dropped, and null or unseen values have no indicator set."""
    levels = fit_levels(df, columns) if levels is None else levels
    kept = [quoted(c) for c in df.columns if c not in columns]
    indicators = [
        quoted(c).cast("string").eqNullSafe(F.lit(level)).cast("int").alias(f"{c}_{level}")
        for c in columns
        for level in (levels[c][1:] if drop_first else levels[c])
    ]
    return df.select(*kept, *indicators)


def one_hot_text(df: DataFrame, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One-hot of every text column."""
    return one_hot(df, text_columns(df), levels)


def one_hot_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse vector ``column_onehot`` per column.

    Positions follow the sorted levels; null and unseen values are all zero. The
    fitted indexer holds a column's levels on the driver; :func:`frequency_coded`
    codes columns whose levels don't fit there.
    """
    fitted = Pipeline(stages=one_hot_stages(columns)).fit(df)
    return fitted.transform(df).drop(*[f"{c}_code" for c in columns])


def one_hot_stages(columns: Sequence[str]) -> list:
    """The indexer and encoder behind :func:`one_hot_vector`."""
    codes = [f"{c}_code" for c in columns]
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    # the indexer's extra slot for invalid values is the last one, dropped here
    encoder = OneHotEncoder(inputCols=codes, outputCols=[f"{c}_onehot" for c in columns], dropLast=True)
    return [indexer, encoder]


def aligned(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The training features, in order, as doubles after any kept columns:
    missing columns are 0 and extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[quoted(k) for k in keep],
        *[(quoted(f) if f in have else F.lit(0)).cast("double").alias(f) for f in features],
    )


def unmatched_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Training features, or columns behind them, that the table lacks."""
    return [f for f in features if f not in set(df.columns)]


# --- medians and whole preparations ----------------------------------------

def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; one row per column reaches the driver."""
    if not columns:
        return {}
    return {r["column"]: r["median"] for r in medians(df, columns).collect()}


def fit_counted_medians(counted: DataFrame, columns: Sequence[str], rows: str, max_values: int = SMALL_ROWS) -> dict[str, float] | None:
    """Exact median per column of rows that stand for ``rows`` equal ones each. None if the columns have more than
    ``max_values`` different values, which the driver isn't to hold."""
    if not columns:
        return {}
    numbers = [F.nanvl(quoted(c).cast("double"), F.lit(None)).alias(c) for c in columns]
    values = counted.select(quoted(rows), *numbers).unpivot([quoted(rows)], [quoted(c) for c in columns], "column", "value")
    values = values.where("value is not null").groupBy("column", "value").agg(F.sum(quoted(rows)).cast("long").alias("rows"))
    found = values.limit(max_values + 1).collect()
    if len(found) > max_values:
        return None
    out = {}
    for column in {r["column"] for r in found}:
        own = sorted((r["value"], r["rows"]) for r in found if r["column"] == column)
        upto = list(accumulate(n for _, n in own))
        low, high = (own[bisect_right(upto, rank)][0] for rank in ((upto[-1] - 1) // 2, upto[-1] // 2))
        out[column] = low if low == high else low + (high - low) / 2
    return out


def median_filled(df: DataFrame, fitted: Mapping[str, float]) -> DataFrame:
    """Null and NaN numbers replaced by the fitted median."""
    def fill(c):
        if c not in fitted:
            return quoted(c)
        value = quoted(c).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(fitted[c])).alias(c)

    return df.select(*[fill(c) for c in df.columns])


@dataclass
class TablePreparation:
    """Fitted state of the lighter model's preparation: drop rows without a
    target, one-hot the text columns, fill numbers with their median.

    Every text column is encoded in the form declared for it: those in ``vectors``
    stay as they are, for the pipeline to encode as sparse vectors, the others
    become a column per level. Nothing depends on how many levels there are.
    """

    target: str
    levels: dict[str, list[str]] = field(default_factory=dict)
    vectors: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    drop_first: bool = True

    STATE: ClassVar[str] = (
        "target string, levels map<string, array<string>>, vectors array<string>, "
        "medians map<string, double>, drop_first boolean"
    )

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        target: str,
        keys: Sequence[str] = (),
        drop_first: bool = True,
        vectors: Sequence[str] = (),
    ) -> TablePreparation:
        """Levels and medians of the rows that have a target. Key columns pass
        through :meth:`transform` unchanged and are no features."""
        rows = drop_null(df, target)
        apart = {target, *keys, *vectors}
        texts = [c for c in text_columns(rows) if c not in apart]
        numbers = [c for c in numeric_columns(rows) if c not in apart]
        fitted = cls(
            target, fit_levels(rows, texts), list(vectors), fit_medians(rows, numbers), [], drop_first
        )
        fitted.features = [c for c in fitted.transform(rows).columns if c not in apart]
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        rows = drop_null(df, self.target)
        return median_filled(one_hot(rows, list(self.levels), self.levels, self.drop_first), self.medians)

    def transform_new(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """New rows, with or without a target, as aligned training features. A
        number that is missing, or whose column is, takes the training median."""
        known = [c for c in self.levels if c in df.columns]
        absent = {c: F.lit(None).cast("double") for c in self.medians if c not in df.columns}
        absent |= {c: F.lit(None).cast("string") for c in self.vectors if c not in df.columns}
        filled = median_filled(one_hot(df.withColumns(absent), known, self.levels), self.medians)
        return aligned(filled, self.features, [*keep, *self.vectors])

    def unmatched(self, df: DataFrame) -> list[str]:
        """Columns of the training table that new rows lack: their indicators are
        0, their numbers the median."""
        return unmatched_features(df, [*self.levels, *self.vectors, *self.medians])

    def save(self, spark: SparkSession, path: str) -> None:
        save_feature_list(spark, self.features, f"{path}/features")
        state = {k: v for k, v in asdict(self).items() if k != "features"}
        spark.createDataFrame([state], self.STATE).write.mode("overwrite").json(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TablePreparation:
        state = spark.read.schema(cls.STATE).json(f"{path}/state").first().asDict()
        return cls(**state, features=load_feature_list(spark, f"{path}/features"))


def survey_features(df: DataFrame) -> DataFrame:
    """Survey rows with their derived training columns: filtered diet, age
    group and its code, diet code, and indicators of the answers."""
    rows = df.filter(quoted("dietary_habits").isin(*DIET_ORDER))
    rows = label_encoded(age_group(rows), "age_group", "age_group_encoded")
    rows = ordinal_encoded(rows, "dietary_habits", DIET_ORDER, "dietary_encoded")
    return one_hot(rows, ["sleep_duration", "gender", "suicidal_thoughts"])


def prepared_survey(
    df: DataFrame,
    features: Sequence[str],
    age_codes: Mapping[str | None, int],
    levels: Mapping[str, Sequence[str]] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """New survey rows as aligned training features.

    The age codes and levels are those of the training rows, so a new batch is
    coded the same way whatever values it happens to hold.
    """
    rows = df
    if "dietary_habits" in df.columns:
        rows = ordinal_encoded(rows, "dietary_habits", DIET_ORDER, "dietary_encoded")
    if "age_group" in df.columns:
        # null may be a coded level too, which equality would not find
        known = {g: float(code) for g, code in age_codes.items() if g is not None}
        absent = F.when(quoted("age_group").isNull(), F.lit(age_codes.get(None)).cast("double"))
        rows = rows.withColumn("age_group_encoded", F.coalesce(mapped(quoted("age_group"), known), absent))
    texts = [c for c in text_columns(rows) if c not in keep]
    wide = one_hot(rows, texts if levels is None else list(levels), levels)
    return aligned(wide, features, keep)


# --- the saved feature list ------------------------------------------------

def save_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    rows = [(i, name) for i, name in enumerate(features)]
    spark.createDataFrame(rows, "pos int, feature string").write.mode("overwrite").parquet(path)


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("pos").collect()]
