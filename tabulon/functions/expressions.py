"""Value-level expressions: encoding, mapping, parsing and hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, DataType, DateType, DecimalType, DoubleType, FloatType, MapType,
    StructType, TimestampNTZType, TimestampType,
)

# Upper edges of right-closed age ranges and their names.
AGE_EDGES = [13, 17, 23, 29, 34, 39, 44, 49, 54, 59, 64, 69, 130]
AGE_LABELS = [
    "14-17", "18-23", "24-29", "30-34", "35-39", "40-44",
    "45-49", "50-54", "55-59", "60-64", "65-69", "70+",
]

# Diet answers from worst to best.
DIET_ORDER = ["Unhealthy", "Moderate", "Healthy"]

# Texts shown for the two predicted classes.
ADOPTS = "Vai aderir ao Open Finance"
DECLINES = "Não vai aderir ao Open Finance"


def quoted(name: str) -> Column:
    """Column whose name may hold spaces, accents, dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the range (low, high] that holds the value, null outside all."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    expr = F.when(value <= edges[0], None)
    for high, label in zip(edges[1:], labels):
        expr = expr.when(value <= high, label)
    return expr


def ordinal_code(value: Column, order: Sequence[str], unknown: str = "error") -> Column:
    """Position of the value in ``order``; anything else fails or gives null."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    code = F.when(position > 0, (position - 1).cast("double"))
    if unknown == "null":
        return code
    message = F.concat(F.lit("unknown category: "), F.coalesce(value, F.lit("null")))
    return F.coalesce(code, F.raise_error(message).cast("double"))


def mapped(value: Column, mapping: Mapping) -> Column:
    """Replacement per value; unmapped values become null."""
    expr = None
    for key, text in mapping.items():
        expr = F.when(value == key, text) if expr is None else expr.when(value == key, text)
    return expr if expr is not None else F.lit(None).cast("string")


def prediction_text(prediction: Column) -> Column:
    return F.when(prediction == 1, ADOPTS).otherwise(DECLINES)


def decoded_one_hot(
    columns: Sequence[str], names: Sequence[str], first_on_zero: bool = False
) -> Column:
    """Name of the largest indicator, the first one on ties.

    A row without any indicator set has no level and gives null, unless
    ``first_on_zero`` asks for the first name.
    """
    values = [quoted(c) for c in columns]
    largest = F.greatest(*values) if len(values) > 1 else values[0]
    expr = None
    for value, name in zip(values, names):
        hit = value == largest
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr if first_on_zero else F.when(largest > 0, expr)


def key_hash(key: Column, seed: int | str = 42) -> Column:
    """Hex digest that orders rows at random but the same way on every run."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_bucket(digest: Column, digits: int) -> Column:
    """Leading hex digits of a digest as a number; keeps the digest order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def iso_text(value: Column) -> Column:
    """ISO 8601 text; the fraction appears only when there is one."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def _bytes_as_json(value: Column) -> Column:
    """UTF-8 text where the bytes are valid, else the list of byte values."""
    text = value.cast("string")
    numbers = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda i: F.conv(F.hex(F.substring(value, i, F.lit(1))), 16, 10).cast("int"),
    )
    return F.when(F.is_valid_utf8(text), text.cast("variant")).otherwise(numbers.cast("variant"))


def json_ready(value: Column, kind: DataType) -> Column:
    """The value in the form its JSON text needs, containers included."""
    if isinstance(kind, (FloatType, DoubleType)):
        return nan_to_null(value)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return iso_text(value)
    if isinstance(kind, (DateType, DecimalType)):
        return value.cast("string")
    if isinstance(kind, BinaryType):
        return _bytes_as_json(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: json_ready(item, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(
            F.transform(
                F.map_entries(value),
                lambda e: F.struct(e["key"].cast("string"), json_ready(e["value"], kind.valueType)),
            )
        )
    if isinstance(kind, StructType):
        fields = [json_ready(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def json_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row, null fields written as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [json_ready(quoted(c), kinds[c]).alias(c) for c in columns or df.columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
