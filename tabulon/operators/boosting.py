"""Second-order boosted trees with an L2 penalty and native missing values.

Numbers are cut into bins once. Rows of the same bins can't be told apart by any tree, so they become one cell:
its bins, how many rows of each label it holds, and its margin. Gradients are summed as whole numbers, so any
order of the rows, and any way to put them together, gives the same trees.

A learner of a few columns with at most 255 bins has far fewer cells than rows. Up to ``CELLS_IN_ONE_TASK`` of them
a single task grows several trees in a row, since a job per level takes longer than its sums. With more cells, a
pass over them steps each one down the growing tree and sums gradients and hessians per node, feature and bin on
the map side, so that only histograms are shuffled; windows over the histograms find the best split of each node,
and one row per node reaches the driver. A split's gain is measured with the missing rows on either side, and the
better side becomes its default.

Trees grow best split first. A pass splits several open nodes ahead; which splits stay is then decided in their
proper order. Finished trees are added to the cells' margins at once, so a pass walks the growing tree alone, however
many trees there are; every few trees the margins go to a checkpoint.
"""

from __future__ import annotations

import heapq
import math
import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import quoted
from tabulon.operators.trees import NODES, FlatTrees, TreeScorer, matrix
from tabulon.session import shared_dir, task_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Gradients are counted in this part of one.
UNIT = 1 << 24
MISSING = 255
ROWS_PER_TASK = 200_000
#: Cells that one task holds, about 60 bytes each beside what a tree takes for a while.
CELLS_IN_ONE_TASK = 4_000_000
#: Combined bins of columns whose sums are taken together.
PACKED = 1_024
#: Trees after which the margins are written, which ends their chain of steps.
FIXED_EVERY = 20
LOSSES = (-1, -2)  # slots of the training and the validation loss


@dataclass(frozen=True)
class Boosting:
    """The survey learner's settings; the others are customary."""

    rate: float = 0.08
    max_depth: int = 10
    rounds: int = 250
    l2: float = 0.3
    max_leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    bins: int = 255
    patience: int = 10  # rounds without a better validation loss
    tolerance: float = 1e-7


@dataclass
class Split:
    feature: int
    bin: int
    missing_left: bool
    gain: float
    left: tuple[int, int, int]  # gradients, hessians, rows


@dataclass
class Node:
    sums: tuple[int, int, int]
    depth: int = 0
    split: Split | None = None
    children: tuple[int, int] | None = None


@dataclass
class Boosted:
    """Fitted trees, their features, and the losses round by round."""

    features: list[str]
    start: float
    rows: list[dict]  # of NODES
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def scorer(self) -> TreeScorer:
        if not self.rows:  # no split was worth it
            leaf = {"tree": 0, "node": 0, "feature": None, "threshold": None, "missing_left": False,
                    "left": -1, "right": -1, "categories": None, "value": [0.0]}
            return TreeScorer(FlatTrees.from_rows([leaf]), self.features, "odds", self.start)
        return TreeScorer(FlatTrees.from_rows(self.rows), self.features, "odds", self.start)

    def leaves(self) -> list[dict]:
        """tree, path (L and R from the root; empty for a lone root), node and value of each leaf."""
        rows = {(r["tree"], r["node"]): r for r in self.rows}
        out, waiting = [], [(tree, 0, "") for tree, node in rows if node == 0]
        while waiting:
            tree, node, path = waiting.pop()
            row = rows[tree, node]
            if row["left"] < 0:
                out.append({"tree": tree, "path": path, "node": node, "value": row["value"][0]})
            else:
                waiting += [(tree, row["left"], path + "L"), (tree, row["right"], path + "R")]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([tuple(r.values()) for r in self.rows], NODES).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.features, self.start, self.losses)],
                              "features array<string>, start double, losses array<struct<train: double, held_out: double>>"
                              ).write.mode("overwrite").json(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        row = spark.read.schema("features array<string>, start double, losses array<struct<train: double, held_out: double>>"
                                ).json(f"{path}/model").first()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect()
        return cls(list(row["features"]), row["start"], [r.asDict() for r in trees], [tuple(p) for p in row["losses"]])


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 255) -> list[list[float]]:
    """Upper edges of each feature's bins but the last: all values of a column that has no more
    than ``bins``, else values at evenly spaced ranks, from a bounded sketch."""
    values = [F.nanvl(quoted(f).cast("double"), F.lit(None)) for f in features]
    if not values:
        return []
    found = listed_values(df.select(*[v.alias(f"f{i}") for i, v in enumerate(values)]), bins)
    more = [i for i, own in enumerate(found) if own is None]
    if more:
        ranks = [i / bins for i in range(1, bins + 1)]
        for i, ranked in zip(more, df.agg(*[F.percentile_approx(values[i], ranks, 100_000) for i in more]).first()):
            found[i] = ranked or []
    return [sorted(set(own))[:-1] for own in found]


def listed_values(df: DataFrame, most: int) -> list[list[float] | None]:
    """The different values of each column of numbers, nulls aside; None for a column of more than ``most``."""
    width = len(df.columns)

    def run(batches):
        found = [np.zeros(0)] * width
        for batch in batches:
            for i, own in enumerate(found):
                if own is not None:
                    own = np.union1d(own, batch.column(i).unique().drop_null().to_numpy())
                    found[i] = own if len(own) <= most else None
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([None if own is None else own.tolist() for own in found], pa.list_(pa.float64()))],
            ["column", "values"])

    rows = df.mapInArrow(run, "column int, values array<double>").groupBy("column").agg(
        F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"), F.bool_or(F.col("values").isNull()).alias("more")).collect()
    merged = {r["column"]: None if r["more"] or len(r["values"]) > most else r["values"] for r in rows}
    return [merged.get(i, []) for i in range(width)]


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], label: str, held_out: str | None) -> DataFrame:
    """bins (a byte per feature), y and held (whether the row only validates)."""
    cuts = [np.array(e, float) for e in edges]
    names = [f"f{i}" for i in range(len(features))]
    held = F.coalesce(quoted(held_out), F.lit(False)) if held_out else F.lit(False)
    table = df.select(*[quoted(f).cast("double").alias(n) for f, n in zip(features, names)],
                      quoted(label).cast("double").alias("y"), held.alias("held"))

    def run(batches):
        for batch in batches:
            x = matrix([batch.column(n) for n in names], batch.num_rows)
            out = np.empty(x.shape, np.uint8)
            for i, cut in enumerate(cuts):
                out[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(cut, x[:, i], side="left"))
            flat = pa.Array.from_buffers(pa.binary(), len(x), [
                None, pa.py_buffer(np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)[: len(x) + 1].tobytes()),
                pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([flat, batch.column("y").cast(pa.int8()), batch.column("held")], ["bins", "y", "held"])

    return table.mapInArrow(run, "bins binary, y tinyint, held boolean")


def celled(rows: DataFrame) -> DataFrame:
    """A row per different bins: ones and zeros that train, held_ones and held_zeros that only validate, and
    margin. Rows are counted before they are shuffled."""
    def count(of):
        return F.count(F.when(of, 1))

    one = F.col("y") > 0
    return rows.groupBy("bins").agg(
        count(~F.col("held") & one).alias("ones"), count(~F.col("held") & ~one).alias("zeros"),
        count(F.col("held") & one).alias("held_ones"), count(F.col("held") & ~one).alias("held_zeros"),
    ).withColumn("margin", F.lit(0.0))


COUNTS = ("ones", "zeros", "held_ones", "held_zeros")


def _bin_bytes(column: pa.Array, features: int) -> np.ndarray:
    """(row, feature): a row's bins, which lie one after the other in the column's data."""
    if not len(column) or not features:
        return np.zeros((len(column), features), np.uint8)
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * features, int(first)).reshape(len(column), features)


def _bin_matrix(column: pa.Array, features: int) -> np.ndarray:
    """Bins as numbers, the missing one as NaN."""
    flat = _bin_bytes(column, features)
    out = flat.astype(np.float32)
    out[flat == MISSING] = np.nan
    return out


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """(count, cell) of COUNTS."""
    return np.array([batch.column(c).to_numpy().astype(float) for c in COUNTS])


def _gradients(margin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, hessians and rows of each cell, the first two in units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    ones, zeros = counts[:2]
    rows = ones + zeros
    return ones * np.rint((p - 1.0) * UNIT) + zeros * np.rint(p * UNIT), rows * np.rint(p * (1.0 - p) * UNIT), rows


def _lost(margin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """((training, validation), (log loss in units, rows))."""
    plain = np.logaddexp(0.0, margin)
    of_one, of_zero = np.rint((plain - margin) * UNIT), np.rint(plain * UNIT)
    return np.array([[(counts[i] * of_one + counts[i + 1] * of_zero).sum(), counts[i : i + 2].sum()] for i in (0, 2)])


def histograms(cells: DataFrame, features: int, start: float, growing: FlatTrees | None, slots: dict[int, int],
               losses: bool) -> DataFrame:
    """slot, feature, bin, g, h and n of the open nodes, a row per task that has some. ``slots`` numbers the open leaves of
    the growing tree; the losses stand in slots of their own."""
    open_ = max(slots.values(), default=-1) + 1
    width = MISSING + 1

    def run(batches):
        sums = np.zeros((3, open_, features, width))
        lost = np.zeros((2, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, counts = _bin_bytes(batch.column("bins"), features), _counts(batch)
            margin = start + batch.column("margin").to_numpy()
            if losses:
                lost += _lost(margin, counts)
            leaf = growing.leaves(_bin_matrix(batch.column("bins"), features))[0] if growing is not None else np.zeros(len(bins), int)
            table = np.full(int(leaf.max(initial=0)) + 1, -1)
            for node, slot in slots.items():
                if node < len(table):
                    table[node] = slot
            weights = _gradients(margin, counts)
            slot = np.where(weights[2] > 0, table[leaf], -1)
            own = np.flatnonzero(slot >= 0)
            if not len(own):
                continue
            place, weights = slot[own] * width, [w[own] for w in weights]
            for feature in range(features):
                at = place + bins[own, feature]
                for row, weight in enumerate(weights):
                    sums[row, :, feature] += np.bincount(at, weight, open_ * width).reshape(open_, width)
        sums = sums.reshape(3, -1)
        used = np.flatnonzero(sums[2])
        slot, rest = np.divmod(used, features * width)
        feature, bin_ = np.divmod(rest, width)
        out = [slot, feature, bin_, *sums[:, used]]
        if losses:
            out = [np.concatenate([a, b]) for a, b in zip(out, (list(LOSSES), [0, 0], [0, 0], lost[:, 0], [0, 0], lost[:, 1]))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(a).astype(np.int64)).cast(t) for a, t in zip(out, kinds)], ["slot", "feature", "bin", "g", "h", "n"])

    # one shuffle serves the sums and the windows over them; every task has summed its rows
    return cells.mapInArrow(run, "slot int, feature int, bin int, g long, h long, n long").repartition("slot", "feature")


#: Every split of every slot: bins up to ``bin`` go left, and the missing to the side tried. Without
#: missing rows only the larger side is tried. One statement, since a pass must start quickly.
SPLITS = """WITH sums AS (SELECT slot, feature, bin, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM {sent} GROUP BY slot, feature, bin),
whole AS (
  SELECT slot, feature, bin, sum(g) OVER part AS all_g, sum(h) OVER part AS all_h, sum(n) OVER part AS all_n,
    sum(if(bin = {missing}, g, 0)) OVER part AS gone_g, sum(if(bin = {missing}, h, 0)) OVER part AS gone_h,
    sum(if(bin = {missing}, n, 0)) OVER part AS gone_n, sum(g) OVER upto AS to_g, sum(h) OVER upto AS to_h, sum(n) OVER upto AS to_n
  FROM sums WINDOW part AS (PARTITION BY slot, feature),
    upto AS (PARTITION BY slot, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sides AS (
  SELECT *, to_g + if(missing_left, gone_g, 0) AS left_g, to_h + if(missing_left, gone_h, 0) AS left_h, to_n + if(missing_left, gone_n, 0) AS left_n
  FROM whole LATERAL VIEW explode(array(false, true)) AS missing_left
  WHERE bin < {missing} AND (gone_n > 0 OR missing_left = (2 * to_n >= all_n))),
parts AS (
  SELECT *, left_g / {unit} AS lg, left_h / {unit} AS lh, (all_g - left_g) / {unit} AS rg, (all_h - left_h) / {unit} AS rh,
    all_g / {unit} AS ag, all_h / {unit} AS ah FROM sides),
gains AS (SELECT *, try_divide(lg * lg, lh + {l2}) + try_divide(rg * rg, rh + {l2}) - try_divide(ag * ag, ah + {l2}) AS gain FROM parts)
SELECT slot, feature, bin, missing_left, left_g, left_h, left_n, all_g, all_h, all_n, gain,
  slot >= 0 AND least(left_n, all_n - left_n) >= {min_rows} AND least(lh, rh) >= {min_hessian} AND gain > 0 AS allowed FROM gains"""

#: The sums of each slot and its best split; of equal gains the first feature, bin and the right side.
BEST = f"""SELECT slot, g, h, n, best.* FROM (
  SELECT slot, max(all_g) AS g, max(all_h) AS h, max(all_n) AS n,
    min(if(allowed, struct(-gain AS rank, feature, bin, missing_left, left_g, left_h, left_n), null)) AS best
  FROM ({SPLITS}) GROUP BY slot)"""


def _asked(query: str, sent: DataFrame, settings: Boosting) -> DataFrame:
    # a plain number with a point would be read as a decimal
    fixed = {"missing": MISSING, "unit": f"{UNIT}D", "l2": f"{settings.l2}D", "min_rows": settings.min_rows, "min_hessian": f"{settings.min_hessian}D"}
    for name, value in fixed.items():
        query = query.replace(f"{{{name}}}", str(value))
    return sent.sparkSession.sql(query, sent=sent)


def split_gains(sent: DataFrame, settings: Boosting) -> DataFrame:
    return _asked(SPLITS, sent, settings)


def best_splits(sent: DataFrame, settings: Boosting) -> DataFrame:
    return _asked(BEST, sent, settings)


class _Tree:
    """One tree while it grows: nodes by number, split ahead of the order in which they count."""

    def __init__(self, settings: Boosting, root: Node):
        self.settings, self.nodes = settings, [root]

    def accepted(self) -> tuple[list[int], int | None]:
        """Splits in best-first order as far as known, and the node that must be split to go on, if any."""
        heap, taken = [], []

        def push(number):
            if self.nodes[number].split is not None:
                heapq.heappush(heap, (-self.nodes[number].split.gain, number))

        push(0)
        while heap and len(taken) + 1 < self.settings.max_leaves:
            _, number = heapq.heappop(heap)
            if self.nodes[number].children is None:
                return taken, number
            taken.append(number)
            for child in self.nodes[number].children:
                push(child)
        return taken, None

    def last(self, taken: Sequence[int]) -> bool:
        """Whether the next split is the last one, after which nobody asks how to split on."""
        return len(taken) + 2 >= self.settings.max_leaves

    def closed(self) -> list[int]:
        """The most promising nodes that could be split, as many as a tree has leaves."""
        some = [i for i, n in enumerate(self.nodes) if n.split is not None and n.children is None]
        return sorted(some, key=lambda i: -self.nodes[i].split.gain)[: self.settings.max_leaves]

    def open(self, numbers: Sequence[int]) -> list[int]:
        """Split nodes; the children that may split in turn."""
        fresh = []
        for number in numbers:
            node = self.nodes[number]
            left = node.split.left
            right = tuple(a - b for a, b in zip(node.sums, left))
            node.children = len(self.nodes), len(self.nodes) + 1
            for sums in (left, right):
                child = Node(sums, node.depth + 1)
                if child.depth < self.settings.max_depth and sums[2] >= 2 * self.settings.min_rows:
                    fresh.append(len(self.nodes))
                self.nodes.append(child)
        return fresh

    def order(self, splits: Sequence[int]) -> dict[int, int]:
        """Nodes of the tree with these splits, numbered from the root, left before right."""
        split, numbers, order = set(splits), [0], {}
        while numbers:
            number = numbers.pop()
            order[number] = len(order)
            if number in split:
                numbers += reversed(self.nodes[number].children)
        return order

    def value(self, number: int) -> float:
        g, h, _ = self.nodes[number].sums
        return -self.settings.rate * (g / UNIT) / (h / UNIT + self.settings.l2)

    def rows(self, tree: int, splits: Sequence[int], edges=None) -> list[dict]:
        """Rows of NODES with the given splits; thresholds as bins, or as values by ``edges``."""
        split, order, out = set(splits), self.order(splits), []
        for number, place in order.items():
            node = self.nodes[number]
            inner = number in split
            at = node.split.bin if inner else 0
            values = edges[node.split.feature] if inner and edges is not None else None
            threshold = float(at) if values is None else values[at] if at < len(values) else float("inf")
            out.append({
                "tree": tree, "node": place, "feature": node.split.feature if inner else None, "threshold": threshold if inner else None,
                "missing_left": inner and node.split.missing_left, "left": order[node.children[0]] if inner else -1,
                "right": order[node.children[1]] if inner else -1, "categories": None, "value": [self.value(number)],
            })
        return out

    def grown(self) -> tuple[FlatTrees, dict[int, int]]:
        """All splits so far, and the flat number of each node."""
        splits = [i for i, n in enumerate(self.nodes) if n.children is not None]
        return FlatTrees.from_rows(self.rows(0, splits)), self.order(splits)


def _split_of(row) -> Split | None:
    if row["rank"] is None:
        return None
    return Split(row["feature"], row["bin"], row["missing_left"], -row["rank"], (row["left_g"], row["left_h"], row["left_n"]))


@dataclass
class _Stopping:
    """The losses after each round, and whether they say stop."""

    settings: Boosting
    losses: list[tuple[float | None, float | None]] = field(default_factory=list)
    best: float = math.inf
    best_round: int = 0

    def add(self, train: tuple[int, int], held: tuple[int, int]) -> bool:
        """Losses in units and rows, of the rows that train and of those that validate."""
        self.losses.append(tuple(total / UNIT / n if n else None for total, n in (train, held)))
        loss, round_ = self.losses[-1][1], len(self.losses)
        if loss is not None and loss < self.best - self.settings.tolerance:
            self.best, self.best_round = loss, round_
        return loss is not None and round_ - self.best_round >= self.settings.patience


class _Cells:
    """All cells in one place, and the trees that grow on them."""

    def __init__(self, bins: np.ndarray, counts: np.ndarray, margin: np.ndarray, settings: Boosting):
        self.counts, self.margin, self.settings = counts, margin, settings
        # a feature's bins that occur, numbered from its first place; the missing one is the last
        self.bin, self.feature, self.first, codes = [], [], [], []
        for feature in range(bins.shape[1]):
            found = np.flatnonzero(np.bincount(bins[:, feature], minlength=MISSING + 1))
            table = np.zeros(MISSING + 1, np.int64)
            table[found] = np.arange(len(found))
            self.first.append(len(self.bin))
            self.bin += found.tolist()
            self.feature += [feature] * len(found)
            codes.append((bins[:, feature], table, len(found)))
        self.bin, self.feature, self.first = (np.array(a, int) for a in (self.bin, self.feature, self.first))
        self.sizes = np.diff(np.append(self.first, len(self.bin)))
        # columns of few bins are put together, as one sum of their combined bins gives those of each
        self.packs, self.packed = [], []
        for feature in np.argsort(-self.sizes, kind="stable"):
            size = int(self.sizes[feature])
            at = next((i for i, (members, width) in enumerate(self.packs) if width * size <= PACKED), None)
            own = codes[feature][1][codes[feature][0]]
            if at is None:
                self.packs.append(([feature], size))
                self.packed.append(own)
            else:
                members, width = self.packs[at]
                self.packs[at] = ([*members, feature], width * size)
                self.packed[at] = self.packed[at] * size + own

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch], features: int, settings: Boosting) -> _Cells:
        parts = [(_bin_bytes(b.column("bins"), features).copy(), _counts(b), b.column("margin").to_numpy().copy()) for b in batches]
        parts = parts or [(np.zeros((0, features), np.uint8), np.zeros((4, 0)), np.zeros(0))]
        return cls(*(np.concatenate(p, axis=axis) for p, axis in zip(zip(*parts), (0, 1, 0))), settings)

    def sums(self, weights: Sequence[np.ndarray], rows: np.ndarray | None) -> np.ndarray:
        """(sum, feature's bin) of gradients, hessians and rows."""
        out = np.empty((3, len(self.bin)))
        if rows is not None:
            weights = [w.take(rows) for w in weights]
        for (members, width), code in zip(self.packs, self.packed):
            code = code if rows is None else code.take(rows)
            shape = [int(self.sizes[m]) for m in members]
            for i, weight in enumerate(weights):
                whole = np.bincount(code, weight, width).reshape(shape)
                for axis, member in enumerate(members):
                    others = tuple(a for a in range(len(shape)) if a != axis)
                    out[i, self.first[member] : self.first[member] + shape[axis]] = whole.sum(axis=others)
        return out

    def split(self, sums: np.ndarray, whole: tuple[int, int, int]) -> Split | None:
        """The best split, as SPLITS and BEST find it: of equal gains the first feature, bin and the right side."""
        upto = sums.cumsum(axis=1)
        before = np.where(self.first > 0, upto[:, self.first - 1], 0.0)
        to = upto - before[:, self.feature]
        ends = self.first + self.sizes - 1
        gone = np.where(self.bin[ends] == MISSING, sums[:, ends], 0.0)[:, self.feature]
        left = to[:, :, None] + gone[:, :, None] * np.array([0.0, 1.0])
        every = np.array(whole, float)[:, None, None]
        tried = (gone[2][:, None] > 0) | (np.array([False, True]) == (2 * to[2] >= whole[2])[:, None])
        lg, lh = left[0] / UNIT, left[1] / UNIT
        rg, rh = (every[0] - left[0]) / UNIT, (every[1] - left[1]) / UNIT
        ag, ah = whole[0] / UNIT, whole[1] / UNIT
        l2 = self.settings.l2
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lg * lg / (lh + l2) + rg * rg / (rh + l2) - ag * ag / (ah + l2)
        allowed = tried & ((self.bin != MISSING) & (sums[2] > 0))[:, None] & (gain > 0) & np.isfinite(gain)
        allowed &= (np.minimum(left[2], every[2] - left[2]) >= self.settings.min_rows) & (np.minimum(lh, rh) >= self.settings.min_hessian)
        if not allowed.any():
            return None
        best = int(np.where(allowed, gain, -np.inf).argmax())
        place, missing_left = divmod(best, 2)
        return Split(int(self.feature[place]), int(self.bin[place]), bool(missing_left), float(gain[place, missing_left]),
                     tuple(int(v) for v in left[:, place, missing_left]))

    def goes_left(self, split: Split, rows: np.ndarray | None) -> np.ndarray:
        at = next(i for i, (members, _) in enumerate(self.packs) if split.feature in members)
        members, _ = self.packs[at]
        axis, first, size = members.index(split.feature), self.first[split.feature], self.sizes[split.feature]
        own = self.bin[first : first + size]
        side = np.where(own == MISSING, split.missing_left, own <= split.bin)
        shape = [int(self.sizes[m]) for m in members]
        table = np.broadcast_to(side.reshape([size if a == axis else 1 for a in range(len(shape))]), shape).ravel()
        return table.take(self.packed[at] if rows is None else self.packed[at].take(rows))

    def grow(self, start: float) -> tuple[_Tree, list[int]] | None:
        """The next tree and its splits; its values are added to the margins. None if no split is worth it."""
        weights = _gradients(start + self.margin, self.counts)
        whole = tuple(int(w.sum()) for w in weights)
        sums, rows = {0: self.sums(weights, None)}, {0: None}
        split = self.split(sums[0], whole) if len(self.bin) else None
        if split is None:
            return None
        tree = _Tree(self.settings, Node(whole, 0, split))
        while True:
            taken, waiting = tree.accepted()
            if waiting is None:
                break
            last = tree.last(taken)
            left = self.goes_left(tree.nodes[waiting].split, rows[waiting])
            own = rows.pop(waiting)
            fresh = tree.open([waiting])
            one, two = tree.nodes[waiting].children
            for child, side in ((one, left), (two, ~left)):
                rows[child] = np.flatnonzero(side) if own is None else own[side]
            parent = sums.pop(waiting)
            if fresh and not last:
                small, large = sorted((one, two), key=lambda c: len(rows[c]))
                sums[small] = self.sums(weights, rows[small])
                sums[large] = parent - sums[small]
                for child in fresh:
                    tree.nodes[child].split = self.split(sums[child], tree.nodes[child].sums)
        for number, own in rows.items():
            self.margin[own] += tree.value(number)
        return tree, taken


def _grown(cells: DataFrame, features: int, start: float, edges: Sequence[Sequence[float]], stopping: _Stopping,
           round_: int, rounds: int) -> tuple[list[list[dict]], list[list[dict]], _Stopping, bool]:
    """Up to ``rounds`` trees in a row, grown by one task: their rows by values and by bins, the losses after all but the last,
    and whether they are the model's last."""
    def run(batches):
        all_ = _Cells.read(batches, features, stopping.settings)
        trees, steps, ended = [], [], False
        for number in range(round_, round_ + rounds):
            if steps:
                lost = _lost(start + all_.margin, all_.counts)
                ended = stopping.add(*[(int(total), int(n)) for total, n in lost])
            grown = None if ended else all_.grow(start)
            if grown is None:
                ended = True
                break
            tree, taken = grown
            trees.append(tree.rows(number, taken, edges))
            steps.append(tree.rows(0, taken))
        found = trees, steps, (stopping.losses, stopping.best, stopping.best_round), ended
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    (row,) = cells.repartition(1).mapInArrow(run, "found binary").collect()
    trees, steps, (losses, best, best_round), ended = pickle.loads(bytes(row["found"]))
    return trees, steps, _Stopping(stopping.settings, losses, best, best_round), ended


def fit(df: DataFrame, features: Sequence[str], label: str, held_out: str | None = None, settings: Boosting = Boosting(),
        edges: Sequence[Sequence[float]] | None = None) -> Boosted:
    """Boosted trees on rows with a 0/1 label; rows marked ``held_out`` only tell when to
    stop. Null and NaN are missing. Without rows or splits the model is the label's odds."""
    spark, width = df.sparkSession, len(features)
    shared_dir(spark)
    if edges is None:
        edges = bin_edges(df, features, settings.bins)
    kept = celled(binned(df, features, edges, label, held_out)).persist(StorageLevel.MEMORY_AND_DISK)
    ones, n, rows, count = kept.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("ones"), F.col("ones") + F.col("zeros"), sum(F.col(c) for c in COUNTS))],
        F.count(F.lit(1))).first()
    # one task's sums are exact as long as they fit a double's whole numbers
    together = count <= CELLS_IN_ONE_TASK and rows * UNIT < 1 << 53
    before: DataFrame | None = None  # the cells as they were before the last trees
    if not together:  # cells are few by bytes but passed over often, so they are spread by their number
        before, kept = kept, kept.repartition(task_count(spark, count, ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
    model, stopping, round_, written = Boosted(list(features), start_odds(ones, n), []), _Stopping(settings), 0, 0
    while True:
        grows = round_ < settings.rounds
        found = best_splits(histograms(kept, width, model.start, None, {0: 0} if grows else {}, True), settings).collect()
        if before is not None:  # the pass has put the moved cells in their place
            before.unpersist()
            before = None
        by_slot = {r["slot"]: r for r in found}
        if round_ and stopping.add(*[(by_slot[s]["g"], by_slot[s]["n"]) if s in by_slot else (0, 0) for s in LOSSES]):
            break
        root = by_slot.get(0)
        if not grows or root is None or _split_of(root) is None:
            break
        if together:
            # a few times as many trees as there are: few jobs, and a task that is lost takes only its own trees along
            trees, steps, stopping, ended = _grown(
                kept, width, model.start, edges, stopping, round_, min(max(1, 3 * round_), settings.rounds - round_))
        else:
            tree, taken = _by_passes(kept, width, model.start, settings, root)
            trees, steps, ended = [tree.rows(round_, taken, edges)], [tree.rows(0, taken)], False
        model.rows += [row for tree in trees for row in tree]
        if ended:
            break
        round_ += len(trees)
        fixed = round_ - written >= FIXED_EVERY
        written = round_ if fixed else written
        before, kept = kept, _moved(kept, width, [FlatTrees.from_rows(s) for s in steps], fixed)
    kept.unpersist()
    model.losses = stopping.losses
    return model


def _by_passes(cells: DataFrame, features: int, start: float, settings: Boosting, root) -> tuple[_Tree, list[int]]:
    """The next tree and its splits, by passes of all tasks over the cells."""
    tree = _Tree(settings, Node((root["g"], root["h"], root["n"]), 0, _split_of(root)))
    while True:
        taken, waiting = tree.accepted()
        if waiting is None:
            return tree, taken
        if tree.last(taken):
            tree.open([waiting])
            continue
        open_ = tree.open(tree.closed())
        if open_:
            growing, order = tree.grown()
            slots = {order[number]: slot for slot, number in enumerate(open_)}
            for row in best_splits(histograms(cells, features, start, growing, slots, False), settings).collect():
                tree.nodes[open_[row["slot"]]].split = _split_of(row)


def _moved(cells: DataFrame, features: int, trees: Sequence[FlatTrees], written: bool) -> DataFrame:
    """The cells, kept, with the trees' values added to their margins one tree after the other; ``written`` to the shared
    folder first."""
    def run(batches):
        for batch in batches:
            x = _bin_matrix(batch.column("bins"), features)
            margin = batch.column("margin").to_numpy().copy()
            for tree in trees if len(x) else ():
                margin += tree.totals(x)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], batch.schema.names)

    moved = cells.mapInArrow(run, cells.schema)
    return (moved.checkpoint() if written else moved).persist(StorageLevel.MEMORY_AND_DISK)


def root_splits(df: DataFrame, features: Sequence[str], label: str, settings: Boosting = Boosting()) -> DataFrame:
    """Every split that the first tree may begin with: feature, threshold (null: every value goes
    left, only the missing right), missing_left, left_rows and gain."""
    edges = bin_edges(df, features, settings.bins)
    rows = celled(binned(df, features, edges, label, None)).persist(StorageLevel.MEMORY_AND_DISK)
    ones, n = rows.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum(F.col("ones") + F.col("zeros")), F.lit(0))).first()
    found = split_gains(histograms(rows, len(features), start_odds(ones, n), None, {0: 0}, False), settings).where("allowed")
    table = F.array(*[F.array(*[F.lit(float(e)) for e in own]).cast("array<double>") for own in edges])
    return found.select(
        F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1).alias("feature"),
        F.get(F.get(table, F.col("feature")), F.col("bin")).alias("threshold"), "missing_left",
        F.col("left_n").alias("left_rows"), "gain")


def start_odds(ones: int, rows: int) -> float:
    """Log odds of the label; 0 without rows."""
    share = min(max(ones / rows if rows else 0.5, 1e-9), 1 - 1e-9)
    return math.log(share / (1 - share))
