"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Equal vectors are one point; a point keeps its ``k`` + 1 smallest ids, which is all that
ties to smaller ids can ask for, so copies cost nothing and none is lost. Points are
dealt to shards by a hash. In a shard, a graph is built in batches: a greedy beam search
from the entry point proposes neighbours, and relaxed distance pruning keeps an edge
only if no kept neighbour is nearer to its end by the factor ``alpha``; edges are
added both ways and pruned again. One extra coordinate lifts vectors to equal length, so
that nearest by distance is largest by inner product.

A task loads one shard and builds its graph; then all queries stream past it, in blocks, so the
points are moved once however many queries there are. A beam search of each block runs in
double precision on the original vectors, and the best points of all shards are merged.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
neither as query nor as candidate; so do those of another dimension than the most common
one (ties to the smaller). Rows with a null id take no part. A repeated id is one
candidate and, if a query, one query for each different vector: its ranks then come once for each
vector, and its other vectors are candidates. Rows equal in id and vector count once. Fewer candidates than ``k`` give all of them. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import kept, numbered, slices

K = 20
DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM = 96
#: Points of a shard, about, and the least number of shards; rows that are searched together.
SHARD_ROWS, MIN_SHARDS, BATCH_ROWS = 16_384, 8, 256
SALTS = 32
#: Starting points of a search besides the entry point.
SEEDS = 16


def points(df: DataFrame, id_col: str, vector_col: str, k: int = K) -> DataFrame:
    """Distinct vectors with their ``k`` + 1 smallest ids: point (a number of its own), key (its
    hash), vector (doubles), ids.

    Ids are ranked in salted parts first, so that a vector that a third of all rows
    share doesn't meet in one task.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null")
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(usable).distinct()
    key = F.xxhash64("vector")
    rows = rows.select("id", "vector", key.alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    part = Window.partitionBy("key", "vector", "salt").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1).drop("n", "salt")
    whole = Window.partitionBy("key", "vector").orderBy("id")
    some = some.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1)
    found = kept(some.groupBy("key", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    sizes = found.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    size = sizes[0]["d"] if sizes else 0
    # a point's number follows its smallest id; an id with two vectors has two points
    kinds = found.where(F.size("vector") == size)
    return numbered(kinds.orderBy(F.get("ids", F.lit(0)), "key", "vector"), "point").select("point", "key", "vector", "ids")


class Graph:
    """Vectors, out-neighbours (-1: none) and entry point of a shard."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entry: int):
        self.vectors, self.edges, self.entry = vectors, edges, entry

    def search(self, queries: np.ndarray, beam: int, lifted: np.ndarray | None = None):
        """Beam search of all queries in step: ids and scores of the ``beam`` best found, best
        first."""
        base = self.vectors if lifted is None else lifted
        n, count = len(base), len(queries)
        beam = min(beam, n)
        seen = np.zeros((count, n), bool)
        ids = np.full((count, beam), -1, np.int64)
        scores = np.full((count, beam), -np.inf)
        done = np.ones((count, beam), bool)
        # the entry point and a few more, evenly spaced, lest a cluster be out of reach
        starts = np.unique(np.append(np.arange(0, n, max(1, n // SEEDS)), self.entry))[-beam:]
        seen[:, starts] = True
        first = queries @ base[starts].T
        order = np.argsort(-first, axis=1, kind="stable")
        ids[:, : len(starts)] = starts[order]
        scores[:, : len(starts)] = np.take_along_axis(first, order, axis=1)
        done[:, : len(starts)] = False
        active = np.arange(count)
        while len(active):
            at = (~done[active]).argmax(axis=1)  # best that isn't expanded
            open_ = ~done[active, at]
            active, at = active[open_], at[open_]
            if not len(active):
                break
            done[active, at] = True
            nodes = ids[active, at]
            near = self.edges[nodes]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            # an id comes once in a row of edges
            rows, columns = np.nonzero(fresh)
            if not len(rows):
                continue
            who, found = active[rows], near[rows, columns]
            seen[who, found] = True
            got = np.full(near.shape, -np.inf)
            got[rows, columns] = np.einsum("ij,ij->i", queries[who], base[found])
            all_scores = np.concatenate([scores[active], got], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            order = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
            pick = np.arange(len(active))[:, None]
            scores[active], ids[active] = all_scores[pick, order], all_ids[pick, order]
            done[active] = all_done[pick, order] | np.isneginf(scores[active])
        return ids, scores


def lift(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all lengths equal."""
    squares = (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0.0))])


def prune(lifted: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many nodes at once. ``candidates`` holds -1 where there is none."""
    own = lifted[nodes]
    usable = (candidates >= 0) & (candidates != nodes[:, None])
    vectors = lifted[np.maximum(candidates, 0)]
    far = np.where(usable, ((vectors - own[:, None]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    row = np.arange(len(nodes))[:, None]
    candidates, far, vectors = candidates[row, order], far[row, order], vectors[row, order]
    # repeated candidates stand together now or at equal distance; the first one prunes them
    squares = (vectors * vectors).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
    alive = np.isfinite(far)
    out = np.full((len(nodes), degree), -1, np.int64)
    taken = np.zeros(len(nodes), int)
    rows = np.arange(len(nodes))
    for _ in range(degree):
        first = alive.argmax(axis=1)
        live = alive[rows, first]
        if not live.any():
            break
        out[rows[live], taken[live]] = candidates[rows[live], first[live]]
        taken[live] += 1
        gone = alpha * alpha * between[rows, first] <= far
        same = candidates == candidates[rows, first][:, None]
        alive &= ~((gone | same) & live[:, None])
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 128) -> Graph:
    """Two rounds over all points in a fixed random order, without and with relaxation."""
    n = len(vectors)
    lifted = lift(vectors)
    choose = np.random.default_rng(11)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = Graph(vectors, edges, entry)
    if n == 1:
        return graph
    start = choose.integers(0, n, (n, min(8, degree)))
    # an id comes at most once in a row, and no point leads to itself
    start.sort(axis=1)
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
    start[start == np.arange(n)[:, None]] = -1
    edges[:, : start.shape[1]] = start
    for factor in (1.0, alpha):
        order = choose.permutation(n)
        for at in range(0, n, batch):
            nodes = order[at : at + batch]
            # equal lengths: the largest inner product of lifted vectors is the nearest
            found, _ = graph.search(lifted[nodes], beam, lifted)
            candidates = np.concatenate([found, edges[nodes]], axis=1)
            edges[nodes] = prune(lifted, nodes, candidates, degree, factor)
            _link_back(graph, lifted, nodes, degree, factor)
    return graph


def _link_back(graph: Graph, lifted: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """The edges just set, the other way round; a full list is pruned again."""
    edges = graph.edges
    rows, columns = np.nonzero(edges[nodes] >= 0)
    heads, tails = edges[nodes[rows], columns], nodes[rows]
    order = np.argsort(heads, kind="stable")
    heads, tails = heads[order], tails[order]
    owners, first, counts = np.unique(heads, return_index=True, return_counts=True)
    widest = int(counts.max()) if len(counts) else 0
    if not widest:
        return
    added = np.full((len(owners), widest), -1, np.int64)
    added[np.repeat(np.arange(len(owners)), counts), np.arange(len(heads)) - np.repeat(first, counts)] = tails
    known = (added[:, :, None] == edges[owners][:, None, :]).any(axis=2)
    added[known] = -1
    used = (edges[owners] >= 0).sum(axis=1)
    fits = used + (added >= 0).sum(axis=1) <= degree
    for i in np.flatnonzero(fits):
        new = added[i][added[i] >= 0]
        edges[owners[i], used[i] : used[i] + len(new)] = new
    # rows of similar width together, so that a much-linked point doesn't widen all
    full = np.flatnonzero(~fits)
    full = full[np.argsort(counts[full], kind="stable")]
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        both = np.concatenate([edges[owners[some]], added[some, : counts[some].max()]], axis=1)
        edges[owners[some]] = prune(lifted, owners[some], both, degree, alpha)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a table of numbers."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.array(flat, float).reshape(len(column), -1)


def in_shards(found: DataFrame, shards: int) -> DataFrame:
    """Points with their shard, kind 0 and no query's marks."""
    return found.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "point", "vector")


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, search_beam: int = SEARCH_BEAM,
            shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score of each query's ``k`` nearest found.

    ``is_query`` tells from a column of ids which rows are queries.
    """
    found = points(df, id_col, vector_col, k)
    shards = max(min_shards, -(-found.count() // shard_rows))

    # a query vector is searched once, however many rows ask for it
    vector = F.col(vector_col).cast("array<double>")
    asking = df.select(F.col(id_col).cast("long").alias("query_id"), vector.alias("vector")).where(
        is_query(F.col("query_id"))).distinct()
    asked = kept(asking.join(found.select("point", "vector"), "vector").select("query_id", F.col("point").alias("query")))
    queries = asked.select("query").distinct().join(found.select("point", "vector"), F.col("query") == F.col("point")).select("point", "vector")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sent = queries.select(everywhere, F.lit(1).alias("kind"), "point", "vector")
    # a shard's points come first, then all queries stream past its graph; a task per shard
    stream = in_shards(found, shards).unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "point")

    def search(batches):
        waiting, own, names = [], None, None
        for batch in slices(batches, BATCH_ROWS):
            kinds = batch.column("kind").to_numpy()
            index = int((kinds == 0).sum())
            if index:
                waiting.append(batch.slice(0, index))
            if index == batch.num_rows or not waiting and own is None:
                continue  # a shard without points answers nothing
            if own is None:
                held = pa.Table.from_batches(waiting)
                names, waiting = held.column("point").to_numpy(), []
                own = build(matrix(held.column("vector")), degree, beam, alpha)
            asked_points = batch.slice(index)
            ids, scores = own.search(matrix(pa.chunked_array([asked_points.column("vector")])), max(search_beam, k + 1))
            ids, scores = ids[:, : k + 1], scores[:, : k + 1]
            rows, columns = np.nonzero(ids >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked_points.column("point").to_numpy()[rows]), pa.array(names[ids[rows, columns]]), pa.array(scores[rows, columns])],
                ["query", "point", "score"])

    hits = stream.mapInArrow(search, "query long, point long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    # every better point brings at least one id, so k + 1 points hold the k nearest others
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = hits.join(found.select("point", "ids"), "point").select("query", "point", "score", F.explode("ids").alias("id"))
    # the best ids of a vector are the same for all who ask for it, but for themselves
    of_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    named = kept(named.withColumn("n", F.row_number().over(of_query)).where(F.col("n") <= k + 1).drop("n"))
    near = asked.join(named, "query").where((F.col("id") != F.col("query_id")) | (F.col("point") != F.col("query")))
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
