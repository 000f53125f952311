"""Threshold search against scoring every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import topk


def slow(rows, k, every):
    """(query_id, rank, vec_id, score) by Python numbers."""
    out = []
    for at, (query_id, query) in enumerate(rows):
        if query is None or query_id is None or query_id % every:
            continue
        scored = []
        for other, (vec_id, vector) in enumerate(rows):
            if other != at and vector is not None and len(vector) == len(query):
                score = min(max(sum(a * b for a, b in zip(query, vector)), -(1 << 63)), (1 << 63) - 1)
                scored.append((-score, vec_id is None, vec_id or 0))
        for rank, (score, null, vec_id) in enumerate(sorted(scored)[:k]):
            out.append((query_id, rank + 1, None if null else vec_id, -score))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def invented(seed, n, size, most):
    choose = random.Random(seed)
    return [(i, [choose.randint(-most, most) for _ in range(size)]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<long>"


@pytest.mark.parametrize("rows", [
    invented(1, 300, 8, 100), invented(2, 300, 3, 2), invented(3, 60, 1, 1), invented(4, 7, 5, 9),
    [(i, [0, 0, 0]) for i in range(40)], invented(5, 40, 4, 1 << 31) + invented(6, 40, 4, 1 << 40),
    invented(7, 50, 6, 5) * 3 + invented(8, 30, 4, 5) + [(None, [1, 1, 1, 1, 1, 1]), (5, None), (10, [])],
    [(10, [3, -1])] * 200 + invented(9, 50, 2, 4), [],
])
def test_same_as_scoring_all(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("x")).withColumn("shard", F.lit(None)).repartition(3)
    for shard_rows in (16, 16_384):
        assert got(topk.nearest(df, lambda i: i % 5 == 0, F.col("embedding"), k=4, shard_rows=shard_rows)) == slow(rows, 4, 5)


def test_quantised_floats(spark):
    values = [[0.1, -0.1], [1.0, -1.0], [float("nan"), 1.0], [float("inf"), 0.0], None, [0.5, None], [1e300, -1e300]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    vector = F.when(topk.usable(F.col("embedding")), topk.quantised(F.col("embedding"))).alias("v")
    found = {r.vec_id: r.v for r in df.select("vec_id", vector).collect()}
    assert found[0] == [25, -26] and found[1] == [256, -256]
    assert [i for i, v in found.items() if v is None] == [2, 3, 4, 5]
    assert found[6] == [(1 << 63) - 1, -(1 << 63)]
    assert len(got(topk.nearest(df, lambda i: i >= 0, vector))) == 6


def test_stops_before_the_end():
    """One dimension rules: the threshold falls below the k-th score early."""
    choose = np.random.default_rng(1)
    rows = choose.integers(-3, 4, (20_000, 6))
    rows[:, 0] = choose.integers(-10_000, 10_000, len(rows))
    met = []

    class Counted(topk.Lists):
        def _first(self, top, scores, k):
            met.append(len(top))
            return super()._first(top, scores, k)

    lists = Counted(np.arange(len(rows)), np.arange(len(rows)), rows)
    top, scores = lists.best(rows[7], 7, 5)
    every = rows @ rows[7]
    every[7] = -(1 << 60)  # itself is no candidate
    order = np.lexsort((np.arange(len(rows)), -every))[:5]
    assert top.tolist() == order.tolist() and scores == every[order].tolist()
    assert sum(met) < len(rows) / 10
