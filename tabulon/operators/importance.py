"""Global and permutation importance of model features."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulon.functions.expressions import quoted
from tabulon.operators.learners import feature_names, tree_stage
from tabulon.operators.trees import ROWS, LeafSets, TreeScorer, matrix, stage_scorer
from tabulon.session import task_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a ring, about: few enough that a test set of any size spreads over the tasks.
ROWS_PER_BUCKET = 256
ROWS_PER_TASK = 65_536
#: Rows of whole rings that are tried together: a step of one ring takes longer to call than to do.
ROWS_TOGETHER = 8_192


def global_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance) in percent of the total, four decimals, highest
    first; no rows when the model has no tree stage."""
    trees = tree_stage(model)
    rows = []
    if trees is not None:
        rows = list(zip(feature_names(model), trees.featureImportances.toArray().tolist()))
    raw = spark.createDataFrame(rows, "feature string, impurity double")
    total = raw.agg(F.sum("impurity")).scalar()
    share = F.coalesce(F.try_divide("impurity", total), F.col("impurity")) * 100
    return raw.select("feature", F.round(share, 4).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def permutation_importance(
    model,
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    repeats: int = 15,
    seed: int = 42,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mean and deviation of the accuracy lost when one feature is shuffled.

    ``model`` is a tree stage that reads a vector of the named columns, or a
    :class:`~tabulon.operators.trees.TreeScorer`. The rows are thrown into random buckets and put
    in random order there, as a ring; in repeat r a row takes the feature from the r-th row after it.
    Each row steps down all trees once; for a shuffled feature only those trees are walked again that
    test it on the row's own path, and only if the value differs. Trees of few leaves aren't walked: a row's
    leaves that the other features leave open are crossed with those of the value. One shuffle of the rows, no copies.
    """
    scorer = model if isinstance(model, TreeScorer) else stage_scorer(df.sparkSession, model, features)
    width, names = len(features), [f"f{i}" for i in range(len(features))]
    numbers = [quoted(f).cast("double").alias(n) for f, n in zip(features, names)]
    rows = df.select(quoted(key).alias("key"), quoted(label).cast("double").alias("y"), *numbers)
    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    thrown = rows.withColumns({
        "bucket": F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets)), "turn": F.xxhash64("key", F.lit(seed + 1)),
    })

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, total = np.zeros((width + 1, repeats), np.int64), 0
        variants = _variants(scorer)
        for table in _whole_rings(batches):
            x, y = matrix([table.column(n) for n in names], table.num_rows), matrix([table.column("y")], table.num_rows)[:, 0]
            bucket = table.column("bucket").to_numpy()
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(first, len(bucket)))
            if variants is None:
                for at, rows in zip(first.tolist(), size.tolist()):
                    for start in range(0, rows, ROWS):
                        _count_hits(scorer, x[at : at + rows], y[at : at + rows], start, min(start + ROWS, rows), hits)
            else:
                start, count = (np.repeat(a, size) for a in (first, size))
                turn = np.arange(len(x)) - start
                _count_together(scorer, variants, x, y, [start + (turn + r) % count for r in range(1, repeats + 1)], hits)
            total += len(x)
        index, repeat = np.divmod(np.arange(hits.size), repeats)
        yield pa.RecordBatch.from_arrays(
            [pa.array(index - 1, pa.int32()), pa.array(repeat + 1, pa.int32()), pa.array(hits.ravel()), pa.array(np.full(hits.size, total))],
            ["index", "repeat", "hits", "rows"])

    # rings are few by bytes but costly to walk, so the number of tasks is named
    tasks = task_count(df.sparkSession, n, ROWS_PER_TASK)
    placed = thrown.repartition(tasks, "bucket").sortWithinPartitions("bucket", "turn", "key").select("bucket", "y", *names)
    counted = placed.mapInArrow(trial, "index int, repeat int, hits long, rows long").where("rows > 0")
    scores = counted.groupBy("index", "repeat").agg((F.sum("hits") / F.sum("rows")).alias("accuracy"))
    # index -1 holds the hits without a shuffle
    base = Window.partitionBy("repeat")
    drop = (F.max(F.when(F.col("index") < 0, F.col("accuracy"))).over(base) - F.col("accuracy")).alias("drop")
    listed = F.array(*[F.lit(f) for f in features])
    return (
        scores.select("index", drop).where("index >= 0").groupBy("index")
        .agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation"))
        .select(F.element_at(listed, F.col("index") + 1).alias("feature"), "importance", "deviation")
        .orderBy(F.desc("importance"), "feature")
    )


def _count_hits(scorer: TreeScorer, x: np.ndarray, y: np.ndarray, start: int, stop: int, hits: np.ndarray) -> None:
    """Add the hits of rows ``start`` to ``stop`` of a ring: as they are, and per feature and repeat."""
    trees, repeats, size = scorer.trees, hits.shape[1], len(x)
    own, truth = x[start:stop], y[start:stop]
    leaves = trees.leaves(own)
    values = trees.value[leaves]
    right = scorer.predicted(values.sum(axis=0)) == truth
    hits[0] += int(right.sum())
    tested = trees.path_features(x.shape[1])[leaves]
    places = (np.arange(start, stop)[:, None] + np.arange(1, repeats + 1)) % size
    for feature in range(x.shape[1]):
        other = x[places, feature]
        levels, code = np.unique(other, return_inverse=True)
        code = code.reshape(other.shape)
        # a row that meets a value in several repeats is walked once with it
        pairs, where = np.unique(np.arange(len(own))[:, None] * len(levels) + code, return_inverse=True)
        row, level = np.divmod(pairs, len(levels))
        result = right[row].copy()
        before, after = own[row, feature], levels[level]
        changed = np.flatnonzero((before != after) & ~(np.isnan(before) & np.isnan(after)))
        for at in range(0, len(changed), ROWS):
            some = changed[at : at + ROWS]
            moved = own[row[some]].copy()
            moved[:, feature] = after[some]
            new = values[:, row[some]]
            tree, which = np.nonzero(tested[:, row[some], feature])
            new[tree, which] = trees.value[trees.steps(moved, which, trees.roots[tree])]
            result[some] = scorer.predicted(new.sum(axis=0)) == truth[row[some]]
        hits[feature + 1] += result[where.reshape(other.shape)].sum(axis=0)


def _whole_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their bucket, cut where a bucket ends."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < ROWS_TOGETHER:
            continue
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        bucket = whole.column("bucket").to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), rows)
        at = 0
        for place, stop in enumerate(starts[1:-1].tolist()):
            # the last bucket may go on in the next batch
            if starts[place + 2] - at > ROWS_TOGETHER or place == len(starts) - 3:
                yield whole.slice(at, stop - at)
                at = stop
        waiting, rows = [whole.slice(at)], rows - at
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _variants(scorer: TreeScorer):
    """How the trees' values are found with a feature replaced; None if only single steps do."""
    sets = LeafSets.of(scorer.trees, len(scorer.features))
    if sets is not None:
        return _BySets(sets)
    return _ByMasks(scorer) if scorer.trees.masks is not None else None


class _BySets:
    """Trees of few leaves."""

    def __init__(self, sets: LeafSets):
        self.sets = sets

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        return self.sets.codes(x)

    def totals(self, codes: list[np.ndarray], others: list[list]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """Totals of the rows, and with each feature's other codes, a number or a number per row."""
        rows, outputs = len(codes[0]), len(self.sets.values[0])
        own = np.zeros((outputs, rows))
        out = [[np.zeros((outputs, rows)) for _ in other] for other in others]
        for tables, values in zip(self.sets.tables, self.sets.values):
            tested = list(tables)
            reached = [tables[f].take(codes[f]) for f in tested]
            # what the features before and after leave open
            rest, upto = [], np.full(rows, (1 << values.shape[1]) - 1)
            for sets in reached:
                rest.append(upto)
                upto = upto & sets
            base = self.sets.value(values, upto)
            own += base
            upto = np.int64(-1)
            for i in reversed(range(len(tested))):
                rest[i] = rest[i] & upto
                upto = upto & reached[i]
            open_ = dict(zip(tested, rest))
            for f, other in enumerate(others):
                for code, total in zip(other, out[f]):
                    total += self.sets.value(values, open_[f] & tables[f].take(code)) if f in tables else base
        return own.T, [[total.T for total in totals] for totals in out]


class _ByMasks:
    """Trees of many leaves, whose tests have few outcomes: walked where a row's own path tests the feature."""

    def __init__(self, scorer: TreeScorer):
        self.trees, self.width = scorer.trees, len(scorer.features)
        self.tested = self.trees.path_features(self.width)
        self.columns = [[i for i, (feature, _) in enumerate(self.trees.masks.columns) if feature == f] for f in range(self.width)]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """A feature's columns as one number; features that no tree tests have none."""
        self.plain = self.trees.masks.codes(x)
        out = []
        for columns in self.columns:
            code = np.zeros(len(x), np.int64)
            for column in columns:
                code = code * 256 + self.plain[column]
            out.append(code)
        return out

    def totals(self, codes: list[np.ndarray], others: list[list]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        masks, value, rows = self.trees.masks, self.trees.value, len(codes[0])
        leaves = list(masks.walks(self.plain, self.trees.roots))
        bases = [value.take(leaf, axis=0) for leaf in leaves]
        own = np.zeros((rows, value.shape[1]))
        for base in bases:
            own += base
        out = []
        for f, other in enumerate(others):
            out.append([])
            tests = [self.tested[leaf, f] for leaf in leaves] if self.columns[f] else []
            for code in other:
                total, differs = np.zeros_like(own), codes[f] != code
                changed, rest = self.plain.copy(), code
                for column in reversed(self.columns[f]):
                    changed[column], rest = rest % 256, rest // 256
                for tree, base in enumerate(bases):
                    some = np.flatnonzero(tests[tree] & differs) if tests else ()
                    if len(some):
                        base = base.copy()
                        base[some] = value.take(masks.walk(changed, self.trees.roots[tree], some), axis=0)
                    total += base
                out[-1].append(total)
        return own, out


def _count_together(scorer: TreeScorer, variants, x: np.ndarray, y: np.ndarray, places: list[np.ndarray], hits: np.ndarray) -> None:
    """Add the hits of whole rings: as they are, and per feature and repeat, in which a row's value is that at ``places``. A
    feature of fewer codes than repeats is tried with each code, others with what each repeat brings."""
    codes = variants.codes(x)
    present = [np.unique(c) for c in codes]
    by_code = [len(p) <= len(places) for p in present]
    others = [list(p) if few else [c[at] for at in places] for p, few, c in zip(present, by_code, codes)]
    own, totals = variants.totals(codes, others)
    hits[0] += int((scorer.predicted(own) == y).sum())
    for f, tried in enumerate(totals):
        right = np.array([scorer.predicted(total) == y for total in tried])
        for repeat, at in enumerate(places):
            which = np.searchsorted(present[f], codes[f][at]) if by_code[f] else repeat
            hits[f + 1, repeat] += int(right[which, np.arange(len(y))].sum())
