"""Records as tables and tables as JSON rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tabulon.functions.expressions import json_text, quoted
from tabulon.functions.names import CATEGORY_NAMES, FLAG_NAMES

# A client record: ten required categories and ten required 0/1 numbers.
RECORD_SCHEMA = StructType(
    [StructField(c, StringType(), False) for c in CATEGORY_NAMES]
    + [StructField(c, IntegerType(), False) for c in FLAG_NAMES]
)

# The same fields as unchecked text, which is how files and streams are read.
RAW_RECORD_SCHEMA = StructType(
    [StructField("client_id", StringType())]
    + [StructField(c, StringType()) for c in (*CATEGORY_NAMES, *FLAG_NAMES)]
)


def records_table(
    spark: SparkSession, rows: Iterable[Mapping], schema: StructType | str = RECORD_SCHEMA
) -> DataFrame:
    """A few literal records as a table."""
    return spark.createDataFrame([dict(r) for r in rows], schema)


def parsed_json(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """JSON text in ``column`` replaced by its typed fields."""
    others = [quoted(c) for c in df.columns if c != column]
    return df.select(*others, F.from_json(quoted(column), schema).alias("__r")).select(
        *others, "__r.*"
    )


def typed_payload(df: DataFrame, column: str, features: Mapping[str, str]) -> DataFrame:
    """An untyped string map, typed by the feature list; bad values are null."""
    others = [quoted(c) for c in df.columns if c != column]
    fields = [F.try_element_at(quoted(column), F.lit(f)).try_cast(kind).alias(f) for f, kind in features.items()]
    return df.select(*others, *fields)


def json_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON object per row, beside the row's key if one is named."""
    text = json_text(df).alias("json")
    return df.select(quoted(key), text) if key else df.select(text)


def write_json_rows(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)
