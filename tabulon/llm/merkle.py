"""Merkle manifest of a table as a postorder append log.

Rows are leaves of one tree per group; the groups' subroots are the leaves of a last tree,
whose root stands for the table. A node is the hash of up to eight neighbours; while a
level has several nodes, its last run becomes a node too, even if it holds one.

Rows are sorted by range and numbered in their group, so a group of any size is spread.
Aligned builders take 8^``LEVELS`` neighbours each and append nodes as they complete: a
leaf, then every node that it finishes. Their tops are the leaves of the next band of
builders, until one node remains. Where a node stands in the log follows from the number
of leaves alone (``position``), so a proof's siblings are read from a builder's slice of
the log by their places; those above a builder are the same for all its rows and handed down.

A leaf hashes the given columns, each `-` if null, else its UTF-8 byte count, a colon and
the value. Groups ascend bytewise, null first; rows by id (null first), then by leaf hash, so
repeated rows stand together. An empty table has no root and no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tabulon.llm.common import BROADCAST_BYTES, kept, numbered, slices

FAN_BITS, FAN = 3, 8
#: Levels that one builder completes: 4,096 leaves.
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- one tree -----------------------------------------------------------------------------


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def position(level: int, index, leaves: int, levels: int):
    """Place in the log of a tree's ``index``-th node (a number or an array) of a level.

    Before it stand: below it, all nodes up to the last leaf it covers; on its level, those
    to its left; above it, the nodes complete before its first leaf.
    """
    first = np.asarray(index, np.int64) << (FAN_BITS * level)
    end = np.minimum(first + (1 << (FAN_BITS * level)), leaves)
    place = np.asarray(index, np.int64).copy()
    for other in range(levels + 1):
        if other < level:
            place += -(-end >> (FAN_BITS * other))
        elif other > level:
            place += first >> (FAN_BITS * other)
    return place


def append_log(leaves: Sequence[str], levels: int) -> list[str]:
    """The nodes of a builder in the order in which they complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]
    for at, node in enumerate(leaves):
        for level in range(levels + 1):
            log.append(node)
            waiting[level].append(node)
            if level == levels or (len(waiting[level]) < FAN and at < len(leaves) - 1):
                break
            node = sha("".join(waiting[level]))
            waiting[level] = []
    return log


class Slice:
    """A builder's part of the log, read by places."""

    def __init__(self, nodes: bytes, leaves: int, levels: int):
        self.leaves, self.levels = leaves, levels
        self.runs: list[list[str]] = []  # per level, the joined hex digests of each run
        for level in range(levels):
            count = -(-leaves >> (FAN_BITS * level))
            places = position(level, np.arange(count), leaves, levels).tolist()
            digests = [nodes[32 * p : 32 * p + 32].hex() for p in places]
            self.runs.append(["".join(digests[at : at + FAN]) for at in range(0, count, FAN)])

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """What stands left and right of the leaf's ancestor on each level."""
        out = []
        for level, runs in enumerate(self.runs):
            index = leaf >> (FAN_BITS * level)
            run, at = runs[index // FAN], 64 * (index % FAN)
            out.append((run[:at], run[at + 64 :]))
        return out


def folded(digest: str, chain: Sequence[tuple[str, str]]) -> str:
    for left, right in chain:
        digest = sha(left + digest + right)
    return digest


# -- many trees as tables -----------------------------------------------------------------

SLICE = "tree long, run long, n long, levels int, nodes binary, top binary"
CHAIN = "lefts array<string>, rights array<string>"


class Manifest(NamedTuple):
    rows: DataFrame  # id, leaf, claimed, tree, idx, n
    groups: DataFrame  # group, tree, n
    bands: list[DataFrame]  # slices of the groups' trees, from the leaves up
    top: list[DataFrame]  # slices of the tree over the subroots
    subroots: DataFrame  # tree, digest
    root: str | None


def leaf_hash(*columns: Column) -> Column:
    text = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def _schema(ddl: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)


def band(items: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Slices of the log from items (tree, idx, n, digest), one per aligned builder."""
    fields = _schema(SLICE)

    def build(key, table):
        table = table.sort_by("idx")
        total = table.column("n")[0].as_py()
        own = levels if total > FAN**levels else height(total)
        log = append_log([d.hex() for d in table.column("digest").to_pylist()], own)
        nodes = bytes.fromhex("".join(log))
        row = {"tree": key[0].as_py(), "run": key[1].as_py(), "n": total, "levels": own, "nodes": nodes, "top": nodes[-32:]}
        return pa.Table.from_pylist([row], fields)

    run = F.shiftright("idx", FAN_BITS * levels).alias("run")
    return kept(items.select("tree", run, "idx", "n", "digest").groupBy("tree", "run").applyInArrow(build, SLICE))


def forest(items: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Bands of slices until every tree has one node, and these nodes (tree, digest)."""
    bands, subroots = [], None
    while True:
        bands.append(band(items, levels))
        runs = F.ceil(F.col("n") / float(FAN**levels)).cast("long")
        tops = bands[-1].select("tree", F.col("run").alias("idx"), runs.alias("n"), F.col("top").alias("digest"))
        done = tops.where("n = 1").select("tree", "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
        items = tops.where("n > 1")
        if items.isEmpty():
            return bands, subroots


def handed_down(bands: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, run, lefts and rights for the builders of the lowest band: the siblings over
    each. ``above`` has the siblings over each tree (tree, lefts, rights)."""
    schema = f"tree long, idx long, {CHAIN}"
    fields = _schema(schema)

    def expand(batches):
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            leaves = min(FAN**levels, row["n"] - row["run"] * FAN**levels)
            own = Slice(row["nodes"], leaves, row["levels"])
            first = row["run"] * FAN**levels
            for start in range(0, leaves, 512):
                out = []
                for at in range(start, min(start + 512, leaves)):
                    chain = own.siblings(at)
                    out.append({"tree": row["tree"], "idx": first + at, "lefts": [a for a, _ in chain] + row["lefts"],
                                "rights": [b for _, b in chain] + row["rights"]})
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    chains = None
    for at in range(len(bands) - 1, -1, -1):
        own = bands[at]
        ended = own.where(F.col("n") <= FAN**levels).join(above, "tree")
        names = [*own.columns, "lefts", "rights"]
        joined = ended.select(*names)
        if chains is not None:
            over = chains.withColumnRenamed("idx", "run")
            joined = joined.unionByName(own.join(over, ["tree", "run"]).select(*names))
        if at == 0:
            return joined
        chains = kept(joined.mapInArrow(expand, schema))
    raise ValueError("no bands")


def built(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS,
          claimed: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table. ``claimed`` is the hash that a holder of a row comes to, if it
    isn't the leaf's; proofs are checked with it."""
    leaf = leaf_hash(*[F.col(c) for c in columns])
    other = F.coalesce(claimed, leaf) if claimed is not None else leaf
    light = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("claimed"))
    light = numbered(light.orderBy(F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"), "pos")
    groups = light.groupBy("group").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = numbered(groups.orderBy(F.col("group").asc_nulls_first()), "tree")
    held = groups.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("group").cast("string")), F.lit(0)) + 40), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    small = F.broadcast(groups) if held["b"] <= BROADCAST_BYTES else groups
    named = small.withColumnRenamed("group", "__group")
    rows = light.join(named, F.col("group").eqNullSafe(F.col("__group"))).select(
        "id", "leaf", "claimed", "tree", (F.col("pos") - F.col("start")).alias("idx"), "n")
    if not held["n"]:
        return Manifest(rows, groups, [], [], groups.select("tree", F.lit(None).cast("binary").alias("digest")), None)
    bands, subroots = forest(rows.withColumnRenamed("leaf", "digest"), levels)
    top, whole = forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(held["n"]).cast("long").alias("n"), "digest"), levels)
    return Manifest(rows, groups, bands, top, subroots, whole.first()["digest"].hex())


def proofs(manifest: Manifest, id_col: str = "doc_id", levels: int = LEVELS, whole: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf) and verified
    for every row; ``whole`` adds ``proof``, the siblings' digests, level by level, left to right."""
    rows, _, bands, top, subroots, root = manifest
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), *StructType.fromDDL(
        "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        + ", proof string" * whole).fields])
    fields = _schema(schema)
    if root is None:
        return rows.sparkSession.createDataFrame([], schema)
    none = F.array().cast("array<string>")
    nothing = rows.sparkSession.range(1).select(F.col("id").alias("tree"), none.alias("lefts"), none.alias("rights"))
    over_top = handed_down(top, nothing, levels)
    # a slice of the top tree's lowest band holds subroots; its leaves are trees
    over = kept(_leaf_chains(over_top, levels))
    own = handed_down(bands, over, levels).join(subroots.withColumnRenamed("digest", "subroot"), "tree")

    def extract(key, leaves, part):
        leaves = leaves.sort_by("idx")
        row = part.to_pylist()[0]
        held = Slice(row["nodes"], leaves.num_rows, row["levels"])
        upper = list(zip(row["lefts"], row["rights"]))
        rest = "".join(a + b for a, b in upper)
        first = row["run"] * FAN**levels
        subroot = row["subroot"].hex()
        out = []
        for name, leaf, claim, at in zip(*(leaves.column(n).to_pylist() for n in ("id", "leaf", "claimed", "idx"))):
            chain = held.siblings(at - first)
            proof = "".join(a + b for a, b in chain) + rest
            end = folded(folded(claim.hex(), chain), upper)
            out.append((name, leaf.hex(), subroot, root, sha(proof), end, end == root, *([proof] if whole else [])))
        return pa.Table.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out), fields)], schema=fields)

    run = F.shiftright("idx", FAN_BITS * levels).alias("run")
    grouped = rows.select("id", "leaf", "claimed", "idx", "tree", run).groupBy("tree", "run")
    return grouped.cogroup(own.groupBy("tree", "run")).applyInArrow(extract, schema)


def _leaf_chains(own: DataFrame, levels: int) -> DataFrame:
    """tree, lefts and rights for the leaves of slices, whose numbers are trees."""
    schema = f"tree long, {CHAIN}"
    fields = _schema(schema)

    def expand(batches):
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            first = row["run"] * FAN**levels
            leaves = min(FAN**levels, row["n"] - first)
            held = Slice(row["nodes"], leaves, row["levels"])
            for start in range(0, leaves, 512):
                chains = [held.siblings(at) for at in range(start, min(start + 512, leaves))]
                yield pa.RecordBatch.from_pylist([
                    {"tree": first + start + i, "lefts": [a for a, _ in c] + row["lefts"], "rights": [b for _, b in c] + row["rights"]}
                    for i, c in enumerate(chains)], schema=fields)

    return own.mapInArrow(expand, schema)


def log(manifest: Manifest, levels: int = LEVELS) -> DataFrame:
    """group, position (in its tree's log), level, index and digest of every node."""
    schema = "tree long, position long, level int, index long, digest string"
    fields = _schema(schema)

    def nodes_of(level_base: int):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1):
                row = part.to_pylist()[0]
                leaves = min(FAN**levels, row["n"] - row["run"] * FAN**levels)
                for level in range(1 if level_base else 0, row["levels"] + 1):
                    count = -(-leaves >> (FAN_BITS * level))
                    places = position(level, np.arange(count), leaves, row["levels"])
                    index = np.arange(count) + ((row["run"] * FAN**levels) >> (FAN_BITS * level))
                    whole = position(level_base + level, index, row["total"], height(row["total"]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["tree"]] * count, pa.int64()), pa.array(whole), pa.array([level_base + level] * count, pa.int32()),
                        pa.array(index), pa.array([row["nodes"][32 * p : 32 * p + 32].hex() for p in places.tolist()])], schema=fields)

        return run

    totals = manifest.groups.select("tree", F.col("n").alias("total"))
    parts = [
        own.join(totals, "tree").mapInArrow(nodes_of(levels * number), schema) for number, own in enumerate(manifest.bands)
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes.join(manifest.groups.select("tree", "group"), "tree").select("group", "position", "level", "index", "digest")


# -- tampering ----------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_leaf(id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = COLUMNS) -> Column:
    """The hash of a row whose text's A-Z became lower case, where 3 divides the crc32 of the
    decimal id; null elsewhere, so also for a null id."""
    drawn = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in columns]
    return F.when(drawn, leaf_hash(*changed))
