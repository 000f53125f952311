"""Projections, filters and record validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from tabulon.functions.expressions import nan_to_null, quoted
from tabulon.functions.names import CATEGORY_NAMES, FLAG_NAMES


def with_label(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """The source column as a double named ``label``, the source dropped."""
    return df.withColumn(label, quoted(source).cast("double")).drop(source)


def without(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns dropped where they exist."""
    return df.drop(*columns)


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    found = existing(df, columns)
    if not found:
        raise ValueError("none of the wanted columns is in the table")
    return df.select(*[quoted(c) for c in found])


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself, or an error naming the columns it lacks; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(quoted(column) == value)


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with one of the values; null is none of them."""
    return df.filter(quoted(column).isin(*values))


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(quoted(column).isNotNull())


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN replaced by null in every floating-point column."""
    floating = {name for name, kind in df.dtypes if kind in ("float", "double")}
    return df.select(
        *[nan_to_null(quoted(c)).alias(c) if c in floating else quoted(c) for c in df.columns]
    )


def with_prefix(df: DataFrame, listed: Sequence[str], prefix: str) -> DataFrame:
    """The listed columns, then every column whose name has the prefix."""
    named = [c for c in df.columns if c.startswith(prefix) and c not in listed]
    return df.select(*[quoted(c) for c in [*listed, *named]])


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Both halves; they share one scan only if used from one table, so jobs
    that need them together keep the single frame."""
    return df.drop(target), df.select(quoted(target))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _integer(value: Column) -> Column:
    """Whole number from plain digits such as ``1``, ``-2`` or ``1.0``; null otherwise."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.0+)?$"), F.regexp_extract(text, r"^[+-]?[0-9]+", 0).try_cast("int"))


def validated(df: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Raw text records with their fields typed and a ``reject_reason`` list.

    ``fields`` maps each required field to ``string`` or ``int``. A record is
    accepted when the list is empty; nothing is dropped.
    """
    if fields is None:
        fields = {**dict.fromkeys(CATEGORY_NAMES, "string"), **dict.fromkeys(FLAG_NAMES, "int")}
    typed, reasons = [], []
    for name, kind in fields.items():
        raw = quoted(name) if name in df.columns else F.lit(None).cast("string")
        value = _integer(raw) if kind == "int" else raw.cast("string")
        typed.append(value.alias(name))
        reasons.append(
            F.when(raw.isNull(), f"{name}: missing").when(value.isNull(), f"{name}: not an integer")
        )
    others = [quoted(c) for c in df.columns if c not in fields]
    return df.select(*others, *typed, F.array_compact(F.array(*reasons)).alias("reject_reason"))


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.size("reject_reason") == 0).drop("reject_reason")


def rejected(records: DataFrame) -> DataFrame:
    return records.filter(F.size("reject_reason") > 0)
