"""Exact top-k search by Fagin's threshold algorithm.

Rows are dealt evenly to shards. A shard sorts its rows once per dimension. A query reads
all lists from their better end (the lower one for a negative weight), deeper in each
round, and scores every row it meets for the first time in full. No row that it hasn't
met can score more than the threshold, the score of the values at the lists' present
depth; the query stops as soon as its k-th score exceeds it. An equal score goes on, since
a smaller id might still come. The shards' best are merged.

Each shard is loaded once; the queries stream past it, so neither side is held whole and
the rows aren't copied per query.

Every row is a candidate of its own, repeated ids and vectors included, and a query's only
row that isn't its candidate is itself; a repeated query id asks once per row. Vectors that
are null or hold null or non-finite components take no part; a query meets vectors of its own
length. A null id is a candidate (behind equal scores), not a query. Scores are exact; beyond
64 bits they stop at the largest or smallest long. Fewer candidates than k give all of them. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import kept, numbered, slices
from tabulon.session import task_count

K = 5
#: Rows of a shard, at most about, and of the first round; each round reads twice as deep.
SHARD_ROWS, FIRST_DEPTH = 16_384, 8
LOWEST, LAST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)  # the last also stands for a null id


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


def usable(vector: Column) -> Column:
    """No component is null, infinite or NaN."""
    value = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Lists:
    """Rows of one length with a sorted list per dimension."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.numbers, self.ids, self.rows = numbers, ids, rows
        self.largest = int(np.abs(rows.astype(float)).max(initial=0))
        self.exact = rows.astype(float)
        # a column per list, best for positive weights first
        self.order = np.argsort(-self.exact, axis=0, kind="stable").astype(np.int32)
        self.place = {int(n): i for i, n in enumerate(numbers)}

    def best(self, query: np.ndarray, number: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Rows and scores of the ``k`` best, by score and then id, and how deep it read."""
        n = len(self.rows)
        fits = self.largest * int(np.abs(query.astype(float)).max(initial=0)) * max(1, len(query)) < 1 << 53
        weights = query.astype(float) if fits else query.astype(object)
        table = self.exact if fits else self.rows.astype(object)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        own = self.place.get(int(number))
        if own is not None:
            seen[own] = True
        top, scores = np.empty(0, np.int64), weights[:0].copy() if fits else np.empty(0, object)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            stop = min(depth + step, n)
            met = [self.order[depth:stop, up].ravel(), self.order[n - stop : n - depth, down].ravel()]
            if not len(up) and not len(down):  # all scores are zero
                met, stop = [np.arange(n)], n
            new = np.zeros(n, bool)
            for part in met:
                new[part] = True
            new = np.flatnonzero(new & ~seen)
            seen[new] = True
            top, scores = np.append(top, new), np.append(scores, self._clipped(table[new] @ weights))
            keep = self._first(top, scores, k)
            top, scores = top[keep], scores[keep]
            if len(top) == k and stop < n:
                ends = np.append(self.order[stop - 1, up], self.order[n - stop, down])
                lists = np.append(up, down)
                if self._clipped((table[ends, lists] * weights[lists]).sum(keepdims=True))[0] < scores[-1]:
                    break
            depth, step = stop, step * 2
        return top, list(map(int, scores))

    @staticmethod
    def _clipped(scores: np.ndarray) -> np.ndarray:
        """Whole numbers of any size held to 64 bits."""
        return scores if scores.dtype != object else np.clip(scores, LOWEST, LAST)

    def _first(self, top: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        if len(top) > k and scores.dtype != object:  # only what reaches the k-th score is put in order
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            some = np.flatnonzero(scores >= least)
        else:
            some = np.arange(len(top))
        return some[sorted(range(len(some)), key=lambda i: (-scores[some[i]], self.ids[top[some[i]]]))[:k]]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _shard_lists(parts: list[pa.RecordBatch]) -> dict[int, Lists]:
    """Lists by length of vectors."""
    table = pa.Table.from_batches(parts).combine_chunks()
    sizes = np.array([len(v) for v in table.column("vector")])
    found = {}
    for size in np.unique(sizes):
        own = table.take(pa.array(np.flatnonzero(sizes == size))).combine_chunks()
        vectors = own.column("vector").combine_chunks()
        ids = own.column("id").fill_null(LAST).to_numpy()
        found[int(size)] = Lists(own.column("pos").to_numpy(), ids, _matrix(vectors, int(size)))
    return found


def nearest(df: DataFrame, is_query, vector: Column, id_col: str = "vec_id", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score of each query's ``k`` best.

    ``vector`` is an array of whole numbers; null keeps a row out. ``is_query`` tells
    from a column of ids which rows ask.
    """
    rows = numbered(df.select(F.col(id_col).cast("long").alias("id"), vector.cast("array<long>").alias("vector")).where("vector is not null"), "pos")
    shards = task_count(df.sparkSession, rows.count(), shard_rows)
    held = rows.select(F.pmod("pos", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "pos", "id", "vector")
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = rows.where(F.coalesce(is_query(F.col("id")), F.lit(False)))
    sent = asked.select(F.explode(everywhere).alias("shard"), F.lit(1).alias("kind"), "pos", "id", "vector")
    # the number of tasks is named, so that they aren't merged: they are few by bytes
    stream = held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "pos")
    schema = "query long, query_id long, id long, score long"

    def search(batches):
        shard, waiting, lists = None, [], {}
        for part in slices(batches, 1024):
            numbers = part.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                own = part.slice(start, stop - start)
                if numbers[start] != shard:
                    shard, waiting, lists = numbers[start], [], None
                kinds = own.column("kind").to_numpy()
                index = int((kinds == 0).sum())
                if index:
                    waiting.append(own.slice(0, index))
                if index == own.num_rows:
                    continue
                if lists is None:
                    lists, waiting = _shard_lists(waiting) if waiting else {}, []
                out = ([], [], [], [])
                asking = own.slice(index)
                for number, name, value in zip(asking.column("pos").to_pylist(), asking.column("id").to_pylist(), asking.column("vector")):
                    found = lists.get(len(value))
                    if found is None:
                        continue
                    top, scores = found.best(value.values.to_numpy(zero_copy_only=False), number, k)
                    ids = [None if i == LAST else i for i in found.ids[top].tolist()]
                    for values, more in zip(out, ([number] * len(top), [name] * len(top), ids, scores)):
                        values.extend(more)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["query", "query_id", "id", "score"])

    hits = stream.mapInArrow(search, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
