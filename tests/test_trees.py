"""Penalised boosting against a plain version, and flat trees against Spark's own scores."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.functions.names import CATEGORIES, FLAGS
from tabulon.operators import boosting, importance
from tabulon.operators.boosting import UNIT, Boosted, Boosting
from tabulon.operators.importance import permutation_importance
from tabulon.operators.learners import forest_pipeline
from tabulon.operators.scoring import FlatScorer, scored
from tabulon.operators.trees import FlatTrees, TreeScorer, leaf_counts, stage_scorer
from tabulon.plans import training
from tabulon.sources.models import save_model
from tabulon.sources.tables import clients

NAMES = ["a", "b", "c"]


def invented(n, seed=3):
    choose = np.random.default_rng(seed)
    x = np.column_stack([choose.integers(0, 12, n), choose.integers(0, 5, n), choose.integers(0, 3, n)]).astype(float)
    x[choose.random(n) < 0.15, 0] = np.nan
    x[choose.random(n) < 0.1, 2] = np.nan
    odds = np.where(np.isnan(x[:, 0]), 2.0, 0.3 * np.nan_to_num(x[:, 0]) - 1.5) - 0.5 * (x[:, 1] > 2)
    return x, (choose.random(n) < 1 / (1 + np.exp(-odds))).astype(int)


def table(spark, x, y):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


class Slow:
    """The same learner, a row and a split at a time."""

    def __init__(self, x, y, settings):
        self.x, self.s = x, settings
        self.start = math.log(y.mean() / (1 - y.mean()))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(settings.rounds):
            p = 1 / (1 + np.exp(-margin))
            self.g, self.h = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)
            leaves = self.tree()
            if len(leaves) == 1:
                break
            self.trees.append(leaves)
            for rows, value in leaves:
                margin[rows] += value
        self.margin = margin

    def score(self, rows):
        return (self.g[rows].sum() / UNIT) ** 2 / (self.h[rows].sum() / UNIT + self.s.l2)

    def split(self, rows, depth):
        best = None
        if depth == self.s.max_depth:
            return None
        for f in range(self.x.shape[1]):
            v = self.x[rows, f]
            gone = np.isnan(v)
            for cut in np.unique(v[~gone]):
                for missing_left in (False, True):
                    left = np.where(gone, missing_left, v <= cut)
                    if not gone.any() and missing_left != (2 * left.sum() >= len(rows)):
                        continue
                    one, two = rows[left], rows[~left]
                    if min(len(one), len(two)) < self.s.min_rows:
                        continue
                    gain = self.score(one) + self.score(two) - self.score(rows)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, one, two
        return best

    def tree(self):
        every = np.arange(len(self.x))
        leaves, open_ = [(every, 0)], {0: self.split(every, 0)}
        count = 1
        while any(open_.values()) and count < self.s.max_leaves:
            at = max((k for k, v in open_.items() if v), key=lambda k: (open_[k][0], -k))
            _, one, two = open_.pop(at)
            depth = leaves[at][1] + 1
            for part in (one, two):
                leaves.append((part, depth))
                open_[len(leaves) - 1] = self.split(part, depth)
            count += 1
        return [(leaves[k][0], -self.s.rate * (self.g[leaves[k][0]].sum() / UNIT) / (self.h[leaves[k][0]].sum() / UNIT + self.s.l2))
                for k in open_]


@pytest.mark.parametrize("settings", [
    Boosting(rounds=4, max_depth=3, max_leaves=6), Boosting(rounds=2, max_depth=10, max_leaves=31, rate=0.5, l2=5.0),
])
def test_same_trees_as_slow_version(spark, settings):
    x, y = invented(900)
    slow = Slow(x, y, settings)
    df = table(spark, x, y)
    model = boosting.fit(df.repartition(3), NAMES, "y", settings=settings)
    assert len({r["tree"] for r in model.rows}) == len(slow.trees)
    for number, leaves in enumerate(slow.trees):
        own = sorted(r["value"][0] for r in model.rows if r["tree"] == number and r["left"] < 0)
        assert own == pytest.approx(sorted(v for _, v in leaves), abs=1e-9)
    score = [r.score for r in model.scorer().scored(df, ["id"]).orderBy("id").collect()]
    assert score == pytest.approx((1 / (1 + np.exp(-slow.margin))).tolist(), abs=1e-9)
    counted = leaf_counts(model.scorer(), df).groupBy("tree").agg(F.sum("rows").alias("n")).collect()
    assert {r.n for r in counted} == {900}


def test_missing_rows_take_the_better_side(spark):
    """The missing behave like large values, so they go right although most rows go left."""
    value = [float(i % 10) for i in range(400)] + [None] * 60
    rows = [(i, v, int(v is None or v >= 8)) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "id long, v double, y int")
    model = boosting.fit(df, ["v"], "y", settings=Boosting(rounds=1, max_leaves=2))
    root = model.rows[0]
    assert root["threshold"] == 7.0 and not root["missing_left"]
    splits = {(r.threshold, r.missing_left): r.gain for r in boosting.root_splits(df, ["v"], "y").collect()}
    assert splits[7.0, False] > splits[7.0, True] and (None, False) in splits


def test_penalty_shrinks_leaves(spark):
    x, y = invented(300)
    df = table(spark, x, y)
    values = [max(abs(r["value"][0]) for r in boosting.fit(df, NAMES, "y", settings=Boosting(rounds=1, l2=l2)).rows if r["left"] < 0) for l2 in (0.0, 50.0)]
    assert values[1] < values[0]


def test_stops_when_held_out_rows_gain_nothing(spark):
    choose = np.random.default_rng(5)
    rows = [(i, float(choose.integers(0, 50)), int(choose.integers(0, 2)), i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v double, y int, held boolean")
    model = boosting.fit(df, ["v"], "y", "held", Boosting(rounds=30, max_depth=2, patience=2))
    assert len(model.losses) < 30
    assert model.losses[0][0] > model.losses[-1][0]  # the training loss goes on falling


def test_margins_survive_their_fixing(spark, monkeypatch):
    x, y = invented(300, 8)
    df, settings = table(spark, x, y), Boosting(rounds=5, max_depth=2)
    whole = boosting.fit(df, NAMES, "y", settings=settings)
    monkeypatch.setattr(boosting, "FIXED_EVERY", 2)
    assert boosting.fit(df, NAMES, "y", settings=settings).rows == whole.rows


def test_models_without_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 0)], "id long, v double, y int")
    model = boosting.fit(df, ["v"], "y")
    model.save(spark, str(tmp_path / "m"))
    again = Boosted.load(spark, str(tmp_path / "m"))
    assert [r.score for r in again.scorer().scored(df, ["id"]).collect()] == [0.5, 0.5]
    empty = boosting.fit(df.limit(0), ["v"], "y")
    assert empty.rows == [] and empty.start == 0.0


def test_saved_boosting_scores_the_same(spark, tmp_path):
    x, y = invented(300, 2)
    df = table(spark, x, y)
    model = boosting.fit(df, NAMES, "y", settings=Boosting(rounds=3))
    model.save(spark, str(tmp_path / "m"))
    first, second = (m.scorer().scored(df, ["id"]).orderBy("id").collect() for m in (model, Boosted.load(spark, str(tmp_path / "m"))))
    assert first == second


# --- flat trees ------------------------------------------------------------

@pytest.mark.parametrize("learner", [
    lambda: RandomForestClassifier(numTrees=12, maxDepth=6, seed=1, labelCol="y"),
    lambda: GBTClassifier(maxIter=5, maxDepth=4, seed=1, labelCol="y"),
    lambda: DecisionTreeClassifier(maxDepth=5, seed=1, labelCol="y"),
])
def test_flat_scores_equal_sparks(spark, learner):
    x, y = invented(400)
    df = table(spark, np.nan_to_num(x, nan=-1.0), y)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), learner()]).fit(df)
    flat = stage_scorer(spark, fitted.stages[-1], NAMES)
    key = lambda r: r.id
    for a, b in zip(sorted(scored(fitted, df, ["id"]).collect(), key=key), sorted(flat.scored(df, ["id"], tasks=3).collect(), key=key)):
        assert (a.prediction, a.label_text) == (b.prediction, b.label_text) and a.probability == pytest.approx(b.probability, abs=1e-14)


def test_flat_pipeline_scores_categories_as_the_pipeline(spark, base_dir, tmp_path):
    rows = clients(spark, base_dir)
    fitted = forest_pipeline(numTrees=10, maxDepth=6).fit(rows.where("adesao is not null").withColumn("label", F.col("adesao").cast("double")))
    save_model(fitted, str(tmp_path / "m"))
    flat = FlatScorer.load(spark, str(tmp_path / "m"))
    assert flat.trees.trees.by_category
    # an unseen level, a null one
    other = rows.withColumn("estado", F.when(F.col("client_id") % 3 == 0, "nowhere").otherwise(F.col("estado")))
    assert sorted(flat.score_table(other, ["client_id"]).collect()) == sorted(scored(fitted, other, ["client_id"]).collect())
    assert flat.trees.features == [*[f"{c}_idx" for c in CATEGORIES], *FLAGS]


def test_flat_scorer_needs_its_stages(spark, tmp_path):
    x, y = invented(100)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["b"], outputCol="features"), DecisionTreeClassifier(labelCol="y")]).fit(table(spark, x, y))
    save_model(fitted, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        FlatScorer.load(spark, str(tmp_path / "m"))


def test_importance_walks_again_only_what_changes(spark):
    """The same accuracies as scoring every shuffled row in full."""
    x, y = invented(500, 4)
    x = np.nan_to_num(x, nan=-1.0)
    df = table(spark, x, y)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"),
                              RandomForestClassifier(numTrees=9, maxDepth=5, seed=2, labelCol="y")]).fit(df)
    scorer = stage_scorer(spark, fitted.stages[-1], NAMES)
    found = {r.feature: (r.importance, r.deviation) for r in permutation_importance(
        scorer, df, NAMES, "id", "y", repeats=4, rows_per_bucket=10**9).collect()}
    turns = df.select("id", F.xxhash64("id", F.lit(43)).alias("t")).orderBy("t", "id").collect()
    order = [r.id for r in turns]
    ring, truth = x[order], y[order]
    base = (scorer.predicted(scorer.trees.totals(ring)) == truth).mean()
    for i, name in enumerate(NAMES):
        drops = []
        for r in range(1, 5):
            moved = ring.copy()
            moved[:, i] = np.roll(ring[:, i], -r)
            drops.append(base - (scorer.predicted(scorer.trees.totals(moved)) == truth).mean())
        assert found[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-12)


def test_paths_know_their_features():
    rows = [
        {"tree": 0, "node": 0, "feature": 1, "threshold": 0.5, "missing_left": True, "left": 1, "right": 2, "categories": None, "value": None},
        {"tree": 0, "node": 1, "feature": None, "threshold": None, "missing_left": False, "left": -1, "right": -1, "categories": None, "value": [1.0]},
        {"tree": 0, "node": 2, "feature": 0, "threshold": None, "missing_left": False, "left": 3, "right": 4, "categories": [0, 2], "value": None},
        {"tree": 0, "node": 3, "feature": None, "threshold": None, "missing_left": False, "left": -1, "right": -1, "categories": None, "value": [2.0]},
        {"tree": 0, "node": 4, "feature": None, "threshold": None, "missing_left": False, "left": -1, "right": -1, "categories": None, "value": [3.0]},
    ]
    rows = [r | {"value": r["value"] or [0.0]} for r in rows]
    trees = FlatTrees.from_rows(rows)
    x = np.array([[0, 0], [0, 1], [1, 1], [2, 9], [7, 9], [np.nan, 9], [0, np.nan]], float)
    assert trees.totals(x)[:, 0].tolist() == [1.0, 2.0, 3.0, 2.0, 3.0, 3.0, 1.0]
    assert trees.path_features(2).tolist() == [[False, False], [False, True], [False, True], [True, True], [True, True]]


def test_survey_job_leaves_model_scores_and_importance(spark, tmp_path):
    x, y = invented(400)
    df = table(spark, x, y)
    training.survey_job(spark, df, NAMES, "y", "id", str(tmp_path), Boosting(rounds=3, max_depth=2), repeats=2)
    scores = spark.read.parquet(f"{tmp_path}/scores")
    assert 70 <= scores.count() <= 90 and scores.where("score < 0 or score > 1").count() == 0
    assert {r.feature for r in spark.read.parquet(f"{tmp_path}/importance").collect()} == set(NAMES)


def invented_trees(steps, categories):
    """Three trees over a number with ``steps`` thresholds, a number and a category, and some rows."""
    rng = np.random.default_rng(7)
    rows, cuts = [], rng.permutation(steps) / 4
    for tree in range(3):
        for node in range(2 * steps + 1):
            inner, listed = node < steps, node % 3 == 2
            rows.append({
                "tree": tree, "node": node, "feature": (2 if listed else int(node % 5 == 1)) if inner else None,
                "threshold": float(cuts[node]) if inner and not listed else None, "missing_left": bool(rng.random() < 0.5),
                "left": 2 * node + 1 if inner else -1, "right": 2 * node + 2 if inner else -1,
                "categories": sorted(rng.choice(categories, 3, replace=False).tolist()) if inner and listed else None,
                "value": [float(rng.random()), float(rng.random())]})
    x = np.column_stack([rng.integers(-4, steps + 4, 1_500) / 4, rng.random(1_500) * steps / 4, rng.integers(-2, categories + 3, 1_500)])
    x[rng.random(x.shape) < 0.1] = np.nan
    return FlatTrees.from_rows(rows), x


@pytest.mark.parametrize("steps, categories, masked", [(40, 9, True), (1, 60, True), (200, 9, False), (40, 90, False)])
def test_masks_lead_to_the_leaves_of_single_steps(steps, categories, masked):
    trees, x = invented_trees(steps, categories)
    assert (trees.masks is not None) == masked
    which = np.tile(np.arange(len(x)), 3)
    stepped = trees.steps(x, which, np.repeat(trees.roots, len(x))).reshape(3, -1)
    assert np.array_equal(trees.leaves(x), stepped)
    assert np.array_equal(trees.totals(x), trees.value[stepped].sum(axis=0))


def test_many_rows_do_not_step_through_all_trees_at_once(monkeypatch):
    trees, x = invented_trees(40, 9)
    monkeypatch.setattr(FlatTrees, "steps", None)
    assert trees.totals(x).shape == (1_500, 2)


def test_trees_grow_without_a_job_per_level(spark, monkeypatch):
    """The trees of one task are those of passes, also with a stop by held-out rows; a task grows many in a row."""
    x, y = invented(900, 4)
    df = table(spark, x, y).withColumn("held", F.col("id") % 4 == 0).repartition(3)
    settings, passes, plain = Boosting(rounds=9, max_leaves=4, patience=2), [], boosting.histograms

    def counted(*asked):
        passes.append(asked)
        return plain(*asked)

    monkeypatch.setattr(boosting, "histograms", counted)
    model = boosting.fit(df, NAMES, "y", "held", settings)
    trees = len({r["tree"] for r in model.rows})
    assert trees > 4 and len(passes) <= 4
    monkeypatch.setattr(boosting, "CELLS_IN_ONE_TASK", 0)
    other = boosting.fit(df, NAMES, "y", "held", settings)
    assert len(passes) > trees and (other.rows, other.losses) == (model.rows, model.losses)


def test_equal_bins_make_one_cell(spark):
    df = table(spark, *invented(400)).withColumn("held", F.col("id") % 5 == 0)
    edges = boosting.bin_edges(df, NAMES)
    cells = boosting.celled(boosting.binned(df, NAMES, edges, "y", "held")).collect()
    assert len(cells) == df.select(*NAMES).distinct().count() < 400
    assert sum(c.ones + c.held_ones for c in cells) == df.where("y = 1").count()
    assert sum(c.held_ones + c.held_zeros for c in cells) == 80


def test_edges_of_few_and_many_values(spark):
    df = spark.range(3_000, numPartitions=5).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"),
                                                    F.lit(None).cast("double").alias("none"))
    few, many, none = boosting.bin_edges(df, ["few", "many", "none"], 20)
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and none == []
    assert many == pytest.approx([150 * i for i in range(1, 20)], abs=2)


def single_tree(number, depth, outputs, choose):
    """Nodes of a random tree over four features."""
    rows = []

    def add(level):
        place = len(rows)
        rows.append(None)
        leaf = level == depth or (level > 1 and choose.random() < 0.2)
        rows[place] = {"tree": number, "node": place, "feature": None if leaf else int(choose.integers(4)),
                       "threshold": None if leaf else float(choose.integers(8)), "missing_left": bool(choose.random() < 0.5),
                       "left": -1, "right": -1, "categories": None, "value": choose.random(outputs).tolist()}
        if not leaf:
            rows[place]["left"], rows[place]["right"] = add(level + 1), add(level + 1)
        return place

    add(0)
    return rows


@pytest.mark.parametrize("depth, outputs, way", [(4, 1, "_BySets"), (4, 2, "_BySets"), (8, 1, "_ByMasks"), (0, 1, "_BySets")])
def test_rings_tried_together_count_as_single_steps(depth, outputs, way):
    choose = np.random.default_rng(11)
    trees = FlatTrees.from_rows([row for t in range(8) for row in single_tree(t, depth, outputs, choose)])
    scorer = TreeScorer(trees, list("abcde"), "odds" if outputs == 1 else "votes", start=-4.0)
    x = np.column_stack([choose.integers(0, n, 600) for n in (9, 40, 2, 3, 4)]).astype(float)
    x[choose.random(x.shape) < 0.05] = np.nan
    y, first, size = choose.integers(0, 2, 600).astype(float), [0, 250, 251], [250, 1, 349]
    slow, together = np.zeros((6, 12), np.int64), np.zeros((6, 12), np.int64)
    for at, rows in zip(first, size):
        importance._count_hits(scorer, x[at : at + rows], y[at : at + rows], 0, rows, slow)
    variants = importance._variants(scorer)
    assert type(variants).__name__ == way
    start, count = np.repeat(first, size), np.repeat(size, size)
    importance._count_together(scorer, variants, x, y, [start + (np.arange(600) - start + r) % count for r in range(1, 13)], together)
    assert np.array_equal(slow, together)


def test_rings_stay_whole_across_batches(monkeypatch):
    monkeypatch.setattr(importance, "ROWS_TOGETHER", 10)
    bucket = np.repeat(np.arange(9), [1, 4, 30, 2, 2, 9, 11, 1, 7])
    batches = [pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 6])], ["bucket"]) for at in range(0, len(bucket), 6)]
    parts = [part.column("bucket").to_pylist() for part in importance._whole_rings(iter(batches))]
    assert sum(parts, []) == bucket.tolist() and len(parts) > 3
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))
