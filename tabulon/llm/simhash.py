"""SimHash near-duplicates by vantage-point trees.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are
partitioned by a vantage-point tree that is fitted on a bounded sample of them: a node
sends a fingerprint inside when its Hamming distance to the vantage point is at most
the node's radius, otherwise outside. By the triangle inequality two fingerprints
within ``bits`` of each other can only be parted when the inner one lies within
``bits`` of the radius; such inner ones visit the outer shard too. A shard links all
its members by a local vantage-point tree with the same rule and exact distances, and
sends on one edge per member to its group's smallest fingerprint, never all pairs.
Edges of all shards are then joined into components by alternating stars.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
appear as often as they come; a null id is never the smallest unless all are null. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import kept, lower_words, slices, small_or_plain

SEED = 42
WORDS = 3
BITS = 2
#: Fingerprints that a shard owns, about.
SHARD_ROWS = 4096
#: Sampled fingerprints for each shard that fit the tree, and their largest number.
SAMPLE_PER_SHARD, MAX_SAMPLE = 32, 1_000_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of all shingles; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    own = lower_words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = [0, *(ends + 1).tolist()]
    ends = ends.tolist()
    last = max(1, len(own) - words + 1)
    stop = ends[words - 1 :] if len(own) >= words else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, last, 8192):  # bounded memory for very long texts
        hashes = np.fromiter(
            (xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : min(at + 8192, last)], stop[at : at + 8192])),
            ">u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > last)
    return int(bits.view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 seed: int = SEED) -> DataFrame:
    """doc, text_key (a hash of the text) and fp (the 64 bits as a signed long) of every row."""
    def run(batches):
        for part in slices(batches):
            values = np.array([fingerprint(t, words, seed) for t in part.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(values.view(np.int64))], ["doc", "text_key", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, text_key long, fp long")


def distances(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def fit_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (vantage point, radius, inner child, outer child); a child below 0 is
    shard -child - 1. Vantage points come from the sample; the radius is the one of
    those near the median with the fewest sampled points just inside it."""
    nodes: list[tuple] = []
    count = [0]

    def grow(points: np.ndarray, parts: int) -> int:
        if parts > 1 and len(points) > 1:
            for vantage in points[[0, len(points) // 2, -1]]:
                near = distances(points, vantage)
                lot = np.bincount(near, minlength=66)
                inside = np.cumsum(lot) / len(points)
                radii = [r for r in range(64) if 0.25 <= inside[r] <= 0.75]
                if radii:
                    radius = min(radii, key=lambda r: lot[max(0, r - BITS + 1) : r + 1].sum() / min(inside[r], 1 - inside[r]))
                    nodes.append(())
                    own = len(nodes) - 1
                    share = max(1, min(parts - 1, round(parts * float(inside[radius]))))
                    low = grow(points[near <= radius], share)
                    nodes[own] = (vantage, radius, low, grow(points[near > radius], parts - share))
                    return own
        count[0] += 1
        return -count[0]

    grow(sample, shards)
    return nodes


def homes(points: np.ndarray, nodes: list[tuple], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index and shard of every place of every point: its own shard and the outer ones
    it visits because it lies within ``bits`` inside a radius."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    found: list[tuple] = []
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if at < 0:
            found.append((who, np.full(len(who), -at - 1, np.int64)))
            continue
        vantage, radius, low, high = nodes[at]
        near = distances(points[who], vantage)
        todo.append((low, who[near <= radius]))
        todo.append((high, who[near > radius - bits]))
    return (np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64),
            np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64))


def local_groups(points: np.ndarray, bits: int = BITS, leaf: int = 512) -> np.ndarray:
    """For each of the distinct points, the index of its group's smallest point, where
    groups are connected by distances of at most ``bits``. Unsigned order of bits."""
    label = np.arange(len(points))
    members = {i: [i] for i in range(len(points))}

    def join(near: np.ndarray) -> None:
        """Unite the groups of these points, the smaller ones into the largest."""
        labels = np.unique(label[near]).tolist()
        if len(labels) > 1:
            largest = max(labels, key=lambda g: len(members[g]))
            for other in labels:
                if other != largest:
                    moved = members.pop(other)
                    label[moved] = largest
                    members[largest] += moved

    todo = [np.arange(len(points))]
    while todo:
        who = todo.pop()
        own = points[who]
        if len(who) > leaf:
            near = distances(own, own[len(who) // 2])
            radius = int(np.median(near))
            inner, outer = who[near <= radius], who[near > radius - bits]
            if len(inner) < len(who) and len(outer) < 0.9 * len(who):
                todo += [inner, outer]
                continue
        for at in range(0, len(who), 256):
            close = distances(own[at : at + 256, None], own[None, at:]) <= bits
            for i in range(len(close)):
                join(who[at + np.flatnonzero(close[i])])
    first = np.empty(len(points), np.int64)
    for group in members.values():
        first[group] = min(group)
    return first


def shard_edges(fps: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b), b the smallest of a's group in a shard, of distinct fingerprints ``fp``."""
    spark = fps.sparkSession
    rows = fps.count()
    shards = max(1, -(-rows // shard_rows))
    # the smallest hashes are a sample that doesn't depend on the partitioning
    size = min(MAX_SAMPLE, SAMPLE_PER_SHARD * shards)
    share = min(1.0, 2 * size / max(rows, 1))
    chosen = fps.where(F.xxhash64("fp") < F.lit(int((share * 2 - 1) * (2**63 - 1)))) if share < 1 else fps
    sample = chosen.orderBy(F.xxhash64("fp")).limit(size).toArrow().column("fp").to_numpy().view(np.uint64)
    nodes = fit_tree(sample, shards) if shards > 1 else []

    def route(batches):
        for part in slices(batches, 8192):
            own = part.column(0).to_numpy(zero_copy_only=False)
            who, shard = homes(own.view(np.uint64), nodes, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[who])], ["shard", "fp"])

    def link(table):
        own = np.sort(table.column("fp").to_numpy().view(np.uint64))
        groups = local_groups(own, bits)
        moved = groups != np.arange(len(own))
        own = own.view(np.int64)
        return pa.table({"a": own[moved], "b": own[groups[moved]]})

    places = fps.mapInArrow(route, "shard long, fp long")
    return places.groupBy("shard").applyInArrow(link, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) of every node that has an edge.

    Alternating stars: every node's larger neighbours are linked to its smallest one,
    then every node's smaller neighbours, until nothing changes.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = kept(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    bits: int = BITS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, text_key, fp, group (one of its fingerprints) and component_id (the smallest id
    linked directly or through others) of every row."""
    prints = kept(fingerprints(df, id_col, text_col, words, seed))
    distinct = kept(prints.groupBy("fp").agg(F.min("doc").alias("first")))
    joined = components(shard_edges(distinct.select("fp"), bits, shard_rows))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("group"))
    smallest = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "group").select(F.col("fp").alias("named_fp"), "group", "component_id")
    return prints.join(named, prints["fp"] == named["named_fp"]).select(
        F.col("doc").alias(id_col), "text_key", "fp", "group", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS,
                seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id, null last,
    then the smallest hash of its text; of rows with equal id and text, any one.

    Only the ids that go are joined to the texts, by broadcast if they are few enough.
    """
    found = kept(near_duplicates(df, id_col, text_col, words, bits, seed, shard_rows).select(
        F.col(id_col).alias("doc"), "text_key", "group"))
    place = F.struct(F.col("doc").isNull(), "doc", "text_key")
    keys = found.groupBy("doc", "text_key", "group").agg(F.count(F.lit(1)).alias("rows"))
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    judged = kept(keys.join(first, "group").withColumn("stays", place == F.col("first")))
    text_key = F.xxhash64(text_col)

    def same(keys_df: DataFrame):
        keys_df = keys_df.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"))
        return small_or_plain(kept(keys_df), 24), F.col(id_col).eqNullSafe(F.col("__doc")) & (text_key == F.col("__key"))

    stay = df.join(*same(judged.where("not stays")), "left_anti")
    repeated = judged.where("stays and rows > 1")
    if repeated.isEmpty():
        return stay
    again = same(repeated)
    once = stay.join(*again, "left_semi").withColumn("__text", text_key).dropDuplicates([id_col, "__text"]).drop("__text")
    return stay.join(*again, "left_anti").unionByName(once)


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint")
