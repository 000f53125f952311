"""Fitted trees as flat arrays, walked for many rows and trees at once.

A forest of any learner becomes one table of nodes, bounded by the learner's settings
(trees times nodes). Rows are scored in Arrow batches: all rows step down all trees together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tabulon.functions.expressions import prediction_text, quoted
from tabulon.session import scratch_path

# scorers travel to the workers by value, so that executors need no copy of the code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = (
    "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, "
    "categories array<int>, value array<double>"
)
#: Rows that step down the trees together.
ROWS = 512
#: Rows that step down one tree together: their codes and the tree stay in a core's cache.
TREE_ROWS = 16_384
#: Codes of a feature that fit the mask of a node.
MASK_BITS = 64


@dataclass
class Masks:
    """Tests of few outcomes: a value becomes the code of its place between the thresholds, or its
    category, and a node is a mask of the codes that go left, missing and unknown ones included."""

    columns: list[tuple[int, np.ndarray | None]]  # feature and its thresholds; None: its categories
    categories: int
    column: np.ndarray  # column of a node's test
    mask: np.ndarray
    children: np.ndarray  # right and left child of node n at 2n and 2n + 1
    leaf: np.ndarray

    @classmethod
    def of(cls, trees: FlatTrees) -> Masks | None:
        """None if a feature has more codes than a mask has bits."""
        leaf = trees.left == np.arange(len(trees.left))
        inner, width = np.flatnonzero(~leaf), trees.lefts.shape[1]
        listed = trees.category[inner] >= 0
        columns, column, mask = [], np.zeros(len(leaf), np.int64), np.zeros(len(leaf), np.uint64)
        one, bits = np.uint64(1), np.arange(MASK_BITS, dtype=np.uint64)
        for feature in np.unique(trees.feature[inner]):
            tests = trees.feature[inner] == feature
            compared, grouped = inner[tests & ~listed], inner[tests & listed]
            if len(compared):
                thresholds, rank = np.unique(trees.threshold[compared], return_inverse=True)
                if len(thresholds) + 2 > MASK_BITS:
                    return None
                mask[compared] = (one << (rank + 1).astype(np.uint64)) - one
                mask[compared] |= trees.missing_left[compared].astype(np.uint64) << np.uint64(len(thresholds) + 1)
                column[compared] = len(columns)
                columns.append((int(feature), thresholds))
            if len(grouped):
                if width + 1 > MASK_BITS:
                    return None
                mask[grouped] = (trees.lefts[trees.category[grouped]].astype(np.uint64) << bits[:width]).sum(axis=1, dtype=np.uint64)
                column[grouped] = len(columns)
                columns.append((int(feature), None))
        children = np.column_stack([trees.right, trees.left]).astype(np.int64).ravel()
        return cls(columns, width, column, mask, children, leaf)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(column, row)."""
        out = np.zeros((max(1, len(self.columns)), len(x)), np.uint8)
        for i, (feature, thresholds) in enumerate(self.columns):
            value = x[:, feature]
            if thresholds is None:
                out[i] = np.where((value >= 0) & (value < self.categories), value, self.categories)
            else:
                out[i] = np.where(np.isnan(value), len(thresholds) + 1, np.searchsorted(thresholds, value))
        return out

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> Iterator[np.ndarray]:
        """Tree after tree, the leaf of every row."""
        return self.walks(self.codes(x), roots)

    def walks(self, codes: np.ndarray, roots: np.ndarray) -> Iterator[np.ndarray]:
        every = np.arange(codes.shape[1])
        return (self.walk(codes, root, every) for root in roots)

    def walk(self, codes: np.ndarray, root: int, some: np.ndarray) -> np.ndarray:
        """Leaves of some rows. Rows that are there step no further, once they are the most."""
        place, one, flat = self.column * codes.shape[1], np.uint64(1), codes.ravel()
        node = np.full(len(some), root, np.int64)
        at, rows, places = node, some, np.arange(len(some))
        while True:
            left = (self.mask.take(at) >> flat.take(place.take(at) + rows)) & one
            at = self.children.take(2 * at + left.view(np.int64))
            there = self.leaf.take(at)
            count = np.count_nonzero(there)
            if 2 * count > len(at):
                node[places] = at
                places = places[~there]
                if not len(places):
                    return node
                at, rows = node[places], some[places]


@dataclass
class LeafSets:
    """Trees of few leaves, without tests on categories: per tree and tested feature, the leaves that a value's code leaves
    open, as bits. What all features leave open is one leaf."""

    thresholds: list[np.ndarray]  # of each feature; a value's code is its place between them, the missing one the last
    tables: list[dict[int, np.ndarray]]
    values: list[np.ndarray]  # (output, leaf) of each tree, leaves in the order of their bits

    #: Bits of a whole number that a double tells apart by its exponent, sign aside.
    LEAVES = 62

    @classmethod
    def of(cls, trees: FlatTrees, features: int) -> LeafSets | None:
        """None if a tree has more leaves or a test on categories."""
        if trees.by_category:
            return None
        inner = trees.left != np.arange(len(trees.left))
        thresholds = [np.unique(trees.threshold[inner & (trees.feature == f)]) for f in range(features)]
        tables, values = [], []
        for root in trees.roots.tolist():
            order, waiting = [], [root]
            while waiting:
                node = waiting.pop()
                order.append(node)
                if inner[node]:
                    waiting += [int(trees.right[node]), int(trees.left[node])]
            leaves = [node for node in order if not inner[node]]
            if len(leaves) > cls.LEAVES:
                return None
            below = {node: 1 << bit for bit, node in enumerate(leaves)}
            own: dict[int, np.ndarray] = {}
            for node in reversed(order):
                if not inner[node]:
                    continue
                left, right, f = below[int(trees.left[node])], below[int(trees.right[node])], int(trees.feature[node])
                below[node] = left | right
                codes = np.arange(len(thresholds[f]) + 2)
                goes_left = codes <= np.searchsorted(thresholds[f], trees.threshold[node])
                goes_left[-1] = trees.missing_left[node]
                table = own.setdefault(f, np.full(len(codes), (1 << len(leaves)) - 1, np.int64))
                table &= np.where(goes_left, ~right, ~left)
            tables.append(own)
            values.append(np.ascontiguousarray(trees.value[leaves].T))
        return cls(thresholds, tables, values)

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each feature."""
        return [np.where(np.isnan(v), len(cuts) + 1, np.searchsorted(cuts, v)) for v, cuts in zip(x.T, self.thresholds)]

    @staticmethod
    def value(values: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """(output, row): values of the one leaf that is left in each set."""
        leaf = (sets.astype(np.float64).view(np.int64) >> 52) - 1023  # the place of the one bit
        return np.array([own.take(leaf) for own in values]) if len(values) > 1 else values[0].take(leaf)


@dataclass
class FlatTrees:
    """Nodes of all trees. A leaf leads to itself, so every row takes ``depth`` steps."""

    feature: np.ndarray  # tested feature; 0 in leaves
    threshold: np.ndarray  # left if not greater
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    category: np.ndarray  # row of ``lefts`` for a test on categories, else -1
    lefts: np.ndarray  # whether a category goes left
    value: np.ndarray  # (node, output)
    roots: np.ndarray
    depth: int

    @classmethod
    def from_rows(cls, rows: Sequence[dict]) -> FlatTrees:
        """From rows of :data:`NODES`; a tree's nodes are numbered from 0, the root."""
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(),
                 pa.list_(pa.int32()), pa.list_(pa.float64()))
        names = [c.strip().split(" ")[0] for c in NODES.split(",")]
        return cls.from_table(pa.table([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names))

    @classmethod
    def from_table(cls, table: pa.Table) -> FlatTrees:
        table = table.sort_by([("tree", "ascending"), ("node", "ascending")]).combine_chunks()
        n = table.num_rows
        number = lambda name, rest: table.column(name).fill_null(rest).to_numpy()
        tree, node = number("tree", 0), number("node", 0)
        first = np.flatnonzero(node == 0)
        start = np.repeat(first, np.diff(np.append(first, n)))
        own, leaf = np.arange(n), number("left", -1) < 0
        left, right = (np.where(leaf, own, start + number(side, 0)).astype(np.int32) for side in ("left", "right"))
        sets = table.column("categories").combine_chunks()
        tests = np.flatnonzero(~leaf & sets.is_valid().to_numpy(zero_copy_only=False))
        listed = sets.take(pa.array(tests))
        codes = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(codes.max(initial=0)) + 1
        lefts, category = np.zeros((max(1, len(tests)), width), bool), np.full(n, -1, np.int32)
        lefts[np.repeat(np.arange(len(tests)), listed.value_lengths().to_numpy(zero_copy_only=False).astype(int)), codes] = True
        category[tests] = np.arange(len(tests))
        values = table.column("value").combine_chunks()
        value = values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        flat = cls(
            np.where(leaf, 0, number("feature", 0)).astype(np.int32), np.where(leaf, np.inf, number("threshold", np.inf)),
            np.asarray(table.column("missing_left").fill_null(False)), left, right, category, lefts, value, first.astype(np.int32), 0,
        )
        assert len(first) == len(np.unique(tree)), "every tree has a root"
        level = flat.roots
        while len(level):
            inner = level[flat.left[level] != level]
            level = np.concatenate([flat.left[inner], flat.right[inner]])
            flat.depth += bool(len(level))
        return flat

    @cached_property
    def masks(self) -> Masks | None:
        return Masks.of(self)

    @property
    def by_category(self) -> bool:
        return bool((self.category >= 0).any())

    def steps(self, x: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Leaves reached from the given nodes by the given rows of ``x``; NaN is missing."""
        by_category = self.by_category
        for _ in range(self.depth):
            value = x[rows, self.feature[nodes]]
            goes_left = value <= self.threshold[nodes]
            missing = np.isnan(value)
            if missing.any():
                goes_left = np.where(missing, self.missing_left[nodes], goes_left)
            if by_category:
                test = self.category[nodes]
                code = np.where(missing | (value < 0) | (value >= self.lefts.shape[1]), 0, value).astype(np.int64)
                known = ~missing & (value >= 0) & (value < self.lefts.shape[1])
                goes_left = np.where(test >= 0, self.lefts[test, code] & known, goes_left)
            nodes = np.where(goes_left, self.left[nodes], self.right[nodes])
        return nodes

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): the leaf of every row in every tree."""
        if len(x) >= ROWS and self.masks:
            return np.array(list(self.masks.leaves(x, self.roots)))
        shape = len(self.roots), len(x)
        rows = np.broadcast_to(np.arange(len(x)), shape).ravel()
        return self.steps(x, rows, np.repeat(self.roots, len(x))).reshape(shape)

    def totals(self, x: np.ndarray) -> np.ndarray:
        """(row, output): values summed tree after tree."""
        out = np.zeros((len(x), self.value.shape[1]))
        if len(x) >= ROWS and self.masks:
            for at in range(0, len(x), TREE_ROWS):
                for leaf in self.masks.leaves(x[at : at + TREE_ROWS], self.roots):
                    out[at : at + TREE_ROWS] += self.value.take(leaf, axis=0)
            return out
        for at in range(0, len(x), ROWS):
            # the sum runs over the first axis, so trees are added in their order
            out[at : at + ROWS] = self.value[self.leaves(x[at : at + ROWS])].sum(axis=0)
        return out

    def path_features(self, count: int) -> np.ndarray:
        """(node, feature): whether a feature is tested on the way to the node."""
        tested = np.zeros((len(self.left), count), bool)
        level = self.roots
        while len(level):
            inner = level[self.left[level] != level]
            for side in (self.left, self.right):
                tested[side[inner]] = tested[inner]
                tested[side[inner], self.feature[inner]] = True
            level = np.concatenate([self.left[inner], self.right[inner]])
        return tested


@dataclass
class TreeScorer:
    """Trees with what turns their totals into probabilities, over named number columns.

    ``kind`` is ``votes`` (a share per class, as forests vote) or ``odds`` (one total,
    ``scale`` times which, plus ``start``, is the log odds of class 1).
    """

    trees: FlatTrees
    features: list[str]
    kind: str
    start: float = 0.0
    scale: float = 1.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        """(row, class)."""
        return self.from_totals(self.trees.totals(x))

    def from_totals(self, totals: np.ndarray) -> np.ndarray:
        if self.kind == "votes":
            whole = totals.sum(axis=1, keepdims=True)
            return np.divide(totals, whole, out=np.zeros_like(totals), where=whole > 0)
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-(self.start + self.scale * totals[:, 0])))
        return np.column_stack([1.0 - p, p])

    def predicted(self, totals: np.ndarray) -> np.ndarray:
        """Class of each row, the first of equally likely ones."""
        return self.from_totals(totals).argmax(axis=1)

    def scored(self, df: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        """The kept columns, predicted class, class probabilities, probability of class 1 and
        class text. The features are columns of numbers; null is missing. ``tasks`` spreads
        rows that lie in fewer partitions than their scoring is worth."""
        kept = df.select(*[quoted(k) for k in keep])
        names = [f"__f{i}" for i in range(len(self.features))]
        table = df.select(*[quoted(k) for k in keep], *[quoted(f).cast("double").alias(n) for f, n in zip(self.features, names)])
        schema = StructType([*kept.schema.fields, *StructType.fromDDL("prediction int, probability array<double>, score double").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self.probability(matrix([batch.column(n) for n in names], batch.num_rows))
                flat = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
                out = [batch.column(i) for i in range(len(keep))]
                out += [pa.array(p.argmax(axis=1), pa.int32()), flat, pa.array(p[:, 1])]
                yield pa.RecordBatch.from_arrays(out, schema.names)

        table = table.repartition(tasks) if tasks else table
        return table.mapInArrow(run, schema).withColumn("label_text", prediction_text(F.col("prediction")))


def leaf_counts(scorer: TreeScorer, df: DataFrame) -> DataFrame:
    """tree, node (per tree) and how many rows end in that leaf."""
    names = [f"__f{i}" for i in range(len(scorer.features))]
    table = df.select(*[quoted(f).cast("double").alias(n) for f, n in zip(scorer.features, names)])
    trees = scorer.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(trees.left), np.int64)
        for batch in batches:
            x = matrix([batch.column(n) for n in names], batch.num_rows)
            for at in range(0, len(x), ROWS):
                counts += np.bincount(trees.leaves(x[at : at + ROWS]).ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        tree = np.searchsorted(trees.roots, used, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int32()), pa.array(used - trees.roots[tree], pa.int32()), pa.array(counts[used])], ["tree", "node", "rows"])

    return table.mapInArrow(run, "tree int, node int, rows long").groupBy("tree", "node").agg(F.sum("rows").alias("rows"))


def matrix(columns: Sequence[pa.Array], rows: int) -> np.ndarray:
    """(row, column) of numbers, null as NaN."""
    out = np.empty((rows, len(columns)))
    for i, column in enumerate(columns):
        out[:, i] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def saved_scorer(spark: SparkSession, path: str, kind: str, features: Sequence[str]) -> TreeScorer:
    """The scorer of a saved Spark tree stage, read from its node table. ``kind`` is the saved
    model's class: a classification tree or forest, or boosted trees.

    Forests vote with their leaves' class shares; boosted trees add predictions times the tree's
    weight, and twice the sum is the log odds.
    """
    nodes = spark.read.parquet(f"{path}/data")
    boosted, single = kind.startswith("GBT"), "treeID" not in nodes.columns
    nodes = nodes.withColumn("treeID", F.lit(0)) if single else nodes.select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = F.transform(stats, lambda x: F.when(total != 0, x / total).otherwise(0.0))
    if boosted:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("__tree", "__metadata", "weights")
        nodes = nodes.join(weights, F.col("treeID") == F.col("__tree"))
        value = F.array(F.col("prediction") * F.col("weights"))
    split = F.col("split")
    rule, categorical = split["leftCategoriesOrThreshold"], split["numCategories"] >= 0
    table = nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), split["featureIndex"].alias("feature"),
        F.when(~categorical, F.get(rule, F.lit(0))).alias("threshold"), F.lit(False).alias("missing_left"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(categorical, F.transform(rule, lambda c: c.cast("int"))).alias("categories"), value.alias("value"),
    ).toArrow()
    trees = FlatTrees.from_table(table)
    return TreeScorer(trees, list(features), "odds", scale=2.0) if boosted else TreeScorer(trees, list(features), "votes")


def stage_scorer(spark: SparkSession, stage, features: Sequence[str]) -> TreeScorer:
    """The scorer of a fitted Spark tree stage, by way of its saved form."""
    path = scratch_path(spark, "trees")
    stage.write().overwrite().save(path)
    return saved_scorer(spark, path, type(stage).__name__, features)
