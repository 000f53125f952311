"""Awkward documents that every operator must stand."""

import random

from pyspark.sql import functions as F


def text(seed: int, lines: int = 8) -> str:
    """Lines of twelve invented words."""
    choose = random.Random(seed)
    word = lambda: "".join(choose.choice("abdeghiklmnorstu") for _ in range(choose.randint(2, 9)))
    return "\n".join(" ".join(word() for _ in range(12)) for _ in range(lines))


def awkward(spark):
    """Nulls in every column, empty, blank, very long, repeated rows, and clashing names."""
    rows = [
        (1, text(1), "a"), (1, text(1), "a"), (2, None, "a"), (3, "", None), (4, " \t\n\x0b ", "b"), (None, text(5), "b"),
        (6, "word " * 200_000, "c"), (7, "x" * 300_000, "c"), (8, text(8), None), (9, text(1), "a"), (10, "ﬁ é ß 中文 \U0001f600", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("fp", "doc", "piece", "length", "offset", "word", "rows", "n", "group", "shard", "full", "size", "line", "host", "key"):
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


def empty(spark):
    return awkward(spark).limit(0)
