"""Helpers the operators share: written intermediate tables, checked broadcasts,
Arrow batches in bounded slices, ASCII words and whole-corpus word counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tabulon.session import shared_dir

#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 256
#: Largest table, in bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20


def kept(df: DataFrame) -> DataFrame:
    """The table computed once, in the folder of ``spark.checkpoint.dir`` that all
    executors share, so that a lost executor costs no recomputation before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, already computed, with a broadcast hint if its rows times
    ``row_bytes`` fit the limit; otherwise as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_row(
    df: DataFrame, columns: list[str], schema: StructType | str, work: Callable[[], Callable[..., dict | tuple]],
) -> DataFrame:
    """One result row for each input row, from ``columns`` only.

    ``work`` is called once per task and returns the function of one row's values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        of_row = work()
        for part in slices(batches):
            rows = [of_row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
            columns_out = list(zip(*rows)) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(values), type=field.type) for values, field in zip(columns_out, target)], schema=target
            )

    return df.select(*columns).mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8, split at space and the five ASCII line and tab characters."""
    return (text or "").encode().split()


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; other letters stay."""
    return (text or "").encode().lower().split()


def word_table(df: DataFrame, text: str, tokens: Callable[[str | None], list[bytes]] = lower_words,
               flush: int = 200_000) -> DataFrame:
    """word (binary) and n: how often each word occurs in all texts.

    Each task counts first and sends one row per distinct word; it hands its counts
    on whenever ``flush`` words have gathered, so its memory is bounded.
    """
    target = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=target
        )

    def count(batches):
        counts: Counter = Counter()
        for part in slices(batches):
            for value in part.column(0).to_pylist():
                counts.update(tokens(value))
            if len(counts) > flush:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    sent = df.select(text).mapInArrow(count, "word binary, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that only depends on the values and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / float(1 << 53)


def word_count(text: Column) -> Column:
    """Number of words, without Python."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def numbered(df: DataFrame, out: str) -> DataFrame:
    """The rows, written once, with dense numbers from 0 in the order of their partitions
    and of the rows there; after a sort, in its order. No task holds more than its rows."""
    rows = kept(df.withColumn("__id", F.monotonically_increasing_id()))
    # an id holds the partition above bit 33
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    number = F.col("__offset") + F.col("__id") - F.shiftleft(F.col("__part"), 33)
    # the broadcast side has a row per partition
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, number.alias(out))
