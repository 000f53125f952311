"""Train and test splits that give the same rows on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.expressions import hash_bucket, key_hash, quoted
from tabulon.operators.bounded import join_small, pinned


def in_train(key: Column, train_percent: int = 80, seed: int = 42) -> Column:
    """Whether the row's key hashes into the training share.

    Unlike ``randomSplit`` the answer depends on the key alone, not on how the
    table is partitioned, and needs no shuffle or sort.
    """
    return hash_bucket(key_hash(key, seed), 8) % 100 < train_percent


def hash_split(
    df: DataFrame, key: str, train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    chosen = in_train(quoted(key), train_percent, seed)
    return df.filter(chosen), df.filter(~chosen)


def random_split(
    df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42
) -> list[DataFrame]:
    """Spark's own seeded split; its rows vary with the partitioning."""
    return df.randomSplit(list(weights), seed=seed)


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42, digits: int = 4
) -> DataFrame:
    """The table with ``in_test``: the ``round(test_share * n)`` rows of each
    label whose unique key hashes lowest.

    A label may hold most of the table, so its rows are never sorted together.
    Counting rows per leading hash digits finds the one bucket in which a
    label's cut falls; only that bucket, one in ``16 ** digits``, is ranked.
    The cut then marks all rows in a plain scan.
    """
    digest = key_hash(quoted(key), seed)
    keyed = df.select(quoted(label).alias("y"), digest.alias("h"), quoted(key).alias("k"))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, digits))

    per_bucket = keyed.groupBy("y", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    of_label = Window.partitionBy("y")
    running = of_label.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.round(F.lit(test_share) * F.sum("rows").over(of_label)).cast("long")
    reached = per_bucket.select("y", "bucket", "rows", F.sum("rows").over(running).alias("upto"), wanted.alias("wanted"))
    cut_bucket = pinned(
        reached.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("rows") < F.col("wanted")))
        .select("y", "bucket", (F.col("wanted") - F.col("upto") + F.col("rows")).alias("take"))
    )
    candidates = join_small(keyed, cut_bucket, ["y", "bucket"])
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))
    cuts = pinned(
        candidates.withColumn("rank", rank).filter(F.col("rank") == F.col("take"))
        .select(F.col("y").alias(label), F.col("h").alias("cut_hash"), F.col("k").alias("cut_key"))
    )
    marked = join_small(df.withColumn("__hash", digest), cuts, [label], "left")
    below = (F.col("__hash") < F.col("cut_hash")) | (
        (F.col("__hash") == F.col("cut_hash")) & (quoted(key) <= F.col("cut_key"))
    )
    return marked.withColumn("in_test", F.coalesce(below, F.lit(False))).drop("__hash", "cut_hash", "cut_key")
