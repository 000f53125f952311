"""Small fitted tables: checked for size, fixed once, then broadcast or joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.session import shared_dir

SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def pin(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Compute a fitted table once so that every later use sees the same rows,
    and tell whether it is small.

    At most ``max_rows`` rows of few bytes become a local relation with a broadcast hint.
    A larger table is checkpointed to the shared folder and joined by shuffle,
    with AQE splitting skewed partitions.
    """
    kept = df.persist()
    try:
        local = _local(kept, max_rows)
        if local is not None:
            return F.broadcast(local), True
        shared_dir(df.sparkSession)
        return kept.checkpoint(), False
    finally:
        kept.unpersist()


def _local(df: DataFrame, max_rows: int, max_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """The table, kept in memory by its caller, as a local relation; None when it
    has more rows or bytes. Both are summed up first, so only a small table is fetched."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        fixed = kind in FIXED_WIDTH or kind.startswith("decimal")
        text = column if kind in ("string", "binary") else F.to_json(F.struct(column))
        size = size + (F.lit(16) if fixed else F.coalesce(F.octet_length(text), F.lit(0)))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows > max_rows or total > max_bytes:
        return None
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def pinned(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    return pin(df, max_rows)[0]


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join to a fitted table, keeping one copy of the keys."""
    renamed = small.select(
        *[small[k].alias(f"__{k}") for k in keys], *[small[c] for c in small.columns if c not in keys]
    )
    condition = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return df.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def numbered(df: DataFrame, order: Sequence[Column], out: str, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Rows with their 0-based position in the given total order.

    A small table is numbered by one window. A larger one is range-partitioned
    and sorted, its row ids kept in a checkpoint, and each partition shifted by
    the number of rows before it, so no task sees more than its own range.
    """
    kept = df.persist()
    try:
        local = _local(kept, max_rows)
        if local is not None:
            position = F.row_number().over(Window.orderBy(*order)) - 1
            return F.broadcast(local.withColumn(out, position.cast("long")))
        shared_dir(df.sparkSession)
        # an id holds the partition number above bit 33 and the row number below
        ids = kept.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    finally:
        kept.unpersist()
    ids = ids.select("*", F.shiftright("__id", 33).alias("__part"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    row = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    # the broadcast side has a row per partition of the sorted table
    return (
        ids.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + row)
        .drop("__id", "__part", "__rows", "__offset")
    )
