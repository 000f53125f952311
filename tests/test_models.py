"""Splits, metrics, training, scoring, explanation and the stream."""

import hashlib
import inspect
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tabulon.functions.expressions import ADOPTS, DECLINES
from tabulon.functions.names import CATEGORIES, FLAGS, to_request_names, to_stored_names
from tabulon.operators import metrics, split
from tabulon.operators.encode import fit_counted_medians, fit_medians, median_filled
from tabulon.operators.importance import global_importance, permutation_importance
from tabulon.operators.learners import BOOSTED, FOREST, boosted_pipeline, feature_names, final_features, forest_pipeline
from tabulon.operators.scoring import LightScorer, PipelineScorer, choose_scorer, score_records, scored
from tabulon.operators.split import hash_split, in_train
from tabulon.plans import catalog, training
from tabulon.sources import models
from tabulon.sources.tables import clients, read_csv
from tabulon.streaming.scoring import read_records, score_stream

SMALL = {"numTrees": 8, "maxDepth": 5}


@pytest.fixture(scope="module")
def table(spark, base_dir):
    return clients(spark, base_dir).persist()


@pytest.fixture(scope="module")
def forest(table):
    return training.train_forest(table, **SMALL)


@pytest.fixture(scope="module")
def light(table):
    columns = ["client_id", "adesao", "estado", "gp_renda", "renda", "usa_pix", "gp_limite_do_cartao"]
    return training.train_light_forest(table.select(*columns), **SMALL)


# --- splits ----------------------------------------------------------------

def test_hash_split_ignores_partitioning(spark):
    ids = spark.range(5_000)
    first = {r.id for r in split.hash_split(ids, "id")[0].collect()}
    again = {r.id for r in split.hash_split(ids.repartition(7), "id")[0].collect()}
    assert first == again and 0.77 < len(first) / 5_000 < 0.83
    want = {i for i in range(5_000) if int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16) % 100 < 80}
    assert first == want


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_stratified_split_is_exact_per_label(spark, digits):
    ids = spark.range(3_001).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("y"))
    rows = split.stratified_split(ids, "y", "id", digits=digits).collect()
    assert len(rows) == 3_001
    for label in ("a", "b", None):
        part = sorted(
            ((hashlib.md5(f"{r.id}:42".encode()).hexdigest(), r.id, r.in_test) for r in rows if r.y == label)
        )
        wanted = int(0.2 * len(part) + 0.5)
        assert [p[2] for p in part] == [True] * wanted + [False] * (len(part) - wanted)


# --- metrics ---------------------------------------------------------------

def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=1, max_size=120), st.sampled_from([2, 5, 1000]))
def test_auc_of_any_scores(spark, pairs, ranges):
    table = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")
    got = metrics.area_under_roc(table, "y", "s", ranges).first()["auc"]
    want = brute_auc(*zip(*pairs))
    assert got == (None if want is None else pytest.approx(want))


def test_auc_without_rows(spark):
    table = spark.createDataFrame([(None, 1.0), (1, None)], "y int, s double")
    assert metrics.area_under_roc(table, "y", "s").first()["auc"] is None


def test_metrics_agree_with_spark_evaluators(spark):
    rng = np.random.default_rng(3)
    rows = [(float(y), float(p), float(s)) for y, p, s in zip(rng.integers(0, 2, 500), rng.integers(0, 2, 500), rng.random(500).round(2))]
    table = spark.createDataFrame(rows, "label double, prediction double, score double")
    got = metrics.evaluate(table, "label", "prediction", "score")
    for name in ("accuracy", "f1"):
        assert got[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(table))
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert got["auc"] == pytest.approx(exact.evaluate(table))


def test_classes_nulls_and_nan(spark):
    rows = [(0.0, 0.0), (1.0, 2.0), (2.0, 2.0), (1.5, 1.0), (None, 1.0), (1.0, None)]
    table = spark.createDataFrame(rows, "y double, p double")
    matrix = metrics.confusion_matrix(table, "y", "p")
    assert matrix.columns == ["actual", "predicted_0", "predicted_1", "predicted_1.5", "predicted_2"]
    assert {r[0]: tuple(r)[1:] for r in matrix.collect()} == {0: (1, 0, 0, 0), 1: (0, 0, 0, 1), 1.5: (0, 1, 0, 0), 2: (0, 0, 0, 1)}
    report = {r["class"]: r for r in metrics.class_report(table, "y", "p").collect()}
    assert set(report) == {"0", "1", "1.5", "2", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].f1 == metrics.accuracy(table, "y", "p").first()[0] == 0.5
    scores = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan"))], "y int, s double")
    assert tuple(metrics.area_under_roc(scores, "y", "s").first()) == (1.0, 1, 1)


def test_feature_names_follow_the_learner_with_two_assemblers():
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="v"), VectorAssembler(inputCols=["c"], outputCol="features"),
              DecisionTreeClassifier(featuresCol="v")]
    assert feature_names(Pipeline(stages=stages)) == ["a", "b"]
    with pytest.raises(ValueError):
        feature_names(Pipeline(stages=stages[:2]))


def test_report_of_a_class_never_predicted(spark):
    table = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["class"]: r for r in metrics.class_report(table, "y", "p").collect()}
    assert tuple(rows["1"]) == ("1", 0.0, 0.0, 0.0, 1)
    assert rows["0"].precision == pytest.approx(2 / 3) and rows["0"].recall == 1.0
    assert rows["accuracy"].f1 == pytest.approx(2 / 3) and rows["accuracy"].support == 3
    assert rows["macro avg"].f1 == pytest.approx(0.4)
    assert rows["weighted avg"].f1 == pytest.approx(0.8 * 2 / 3)
    matrix = {r.actual: (r.predicted_0, r.predicted_1) for r in metrics.confusion_matrix(table, "y", "p").collect()}
    assert matrix == {0: (2, 0), 1: (1, 0)}


# --- training and explanation ----------------------------------------------

def test_default_forest_settings(spark):
    stage = forest_pipeline().getStages()[-1]
    assert (stage.getNumTrees(), stage.getMaxDepth(), stage.getMaxBins(), stage.getSeed()) == (300, 10, 200, 42)
    assert FOREST["numTrees"] == 300
    assert feature_names(forest_pipeline()) == final_features() == [f"{c}_idx" for c in CATEGORIES] + FLAGS


def test_forest_learns_and_repeats(table, forest):
    assert forest.metrics["auc"] > 0.7
    again = training.train_forest(table.repartition(5), **SMALL)
    assert again.metrics == forest.metrics


def test_missing_training_column_is_named(table):
    with pytest.raises(ValueError, match="missing columns: usa_pix"):
        training.train_forest(table.drop("usa_pix"), **SMALL)


def test_saved_model_scores_the_same(spark, table, forest, tmp_path):
    path = str(tmp_path / "model")
    training.save_training(spark, forest, path, str(tmp_path / "meta"))
    assert models.model_exists(spark, path) and not models.model_exists(spark, str(tmp_path / "none"))
    before = PipelineScorer(forest.model).score(to_request_names(table), ["client_id"])
    after = PipelineScorer(models.load_model(path)).score(to_request_names(table), ["client_id"])
    assert sorted(before.collect()) == sorted(after.collect())
    saved = models.metadata_dict(spark, str(tmp_path / "meta"))
    assert saved["metrics"] == forest.metrics and saved["final_features"] == final_features()
    assert (saved["num_trees"], saved["max_depth"]) == (8, 5)
    assert models.metadata_dict(spark, str(tmp_path / "none")) == {}


def test_global_importance_sums_to_hundred(spark, forest):
    rows = global_importance(spark, forest.model).collect()
    assert [r.feature for r in rows] != [] and set(r.feature for r in rows) == set(final_features())
    assert sum(r.importance for r in rows) == pytest.approx(100, abs=0.01)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_importance_without_trees_is_empty(spark, table):
    from pyspark.ml import Pipeline
    fitted = Pipeline(stages=forest_pipeline().getStages()[:2]).fit(table)
    assert global_importance(spark, fitted).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [20, 100_000])
def test_permutation_importance_finds_the_useful_feature(spark, rows_per_bucket):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    data = spark.range(400).select(
        "id", (F.col("id") % 2).cast("double").alias("signal"), (F.col("id") % 7).cast("double").alias("noise"),
    ).withColumn("label", F.col("signal"))
    fitted = Pipeline(stages=[
        VectorAssembler(inputCols=["signal", "noise"], outputCol="features"), DecisionTreeClassifier(seed=1),
    ]).fit(data)
    rows = permutation_importance(
        fitted.stages[-1], data, ["signal", "noise"], "id", repeats=5, rows_per_bucket=rows_per_bucket
    ).collect()
    assert [r.feature for r in rows] == ["signal", "noise"]
    assert 0.4 < rows[0].importance < 0.6 and rows[1].importance == 0.0


def test_boosted_trees_stop_early(spark, table):
    data = table.withColumn("x", F.col("renda"))
    trained = training.train_boosted(
        data, ["x", "usa_pix"], "adesao", "client_id", maxIter=5, maxDepth=2
    )
    assert 1 <= trained.model.stages[-1].getNumTrees <= 5
    assert set(trained.metrics) == {"auc", "accuracy", "f1"}


def test_boosted_trees_learn_each_different_row_once(spark, monkeypatch):
    """With their number as weight; the trees are those of all rows."""
    rows = spark.range(3_000).select(
        F.col("id"), F.when(F.col("id") % 11 != 0, (F.col("id") % 7).cast("double")).alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        ((F.col("id") % 7 > 3) != (F.col("id") % 5 == 0)).cast("int").alias("y"))
    given, plain = [], training.fit_and_evaluate

    def seen(train, *rest):
        given.append(train.collect())
        return plain(train, *rest)

    monkeypatch.setattr(training, "fit_and_evaluate", seen)
    trained = training.train_boosted(rows, ["a", "b"], "y", "id", maxIter=4, maxDepth=3)
    counted = given[0]
    expected = hash_split(rows, "id")[0]
    assert sum(r["__rows"] for r in counted) == expected.count() > 10 * len(counted)
    assert trained.medians == fit_medians(expected, ["a", "b"])

    filled = median_filled(expected, trained.medians).withColumn("held_out", ~in_train(F.col("id"), 90, seed=43)).withColumnRenamed("y", "label")
    whole = boosted_pipeline(["a", "b"], validation="held_out", maxIter=4, maxDepth=3).fit(filled)
    cells = filled.select("a", "b").distinct()
    ours, theirs = (sorted((r.a, r.b, round(r.probability[1], 9)) for r in m.transform(cells).collect()) for m in (trained.model, whole))
    assert ours == theirs and trained.model.stages[-1].getNumTrees == whole.stages[-1].getNumTrees


def test_medians_of_counted_rows(spark):
    values = [(1.0, 3), (2.0, 2), (4.0, 1), (None, 5), (float("nan"), 2), (9.0, 0 + 6)]
    counted = spark.createDataFrame([(v, 0.5 if v is None else -(v or 0.0), float(n)) for v, n in values], "x double, z double, n double")
    rows = spark.createDataFrame([(v, 0.5 if v is None else -(v or 0.0)) for v, n in values for _ in range(n)], "x double, z double")
    assert fit_counted_medians(counted, ["x", "z"], "n") == fit_medians(rows, ["x", "z"])
    assert fit_counted_medians(counted, ["x"], "n", max_values=2) is None


def test_survey_queries_train_with_the_production_settings(spark, base_dir, monkeypatch):
    class Stop(Exception):
        pass

    def caught(train, test, pipeline, key, label="label"):
        raise Stop(pipeline)

    monkeypatch.setattr(training, "fit_and_evaluate", caught)
    for name in ("boosted_metrics", "survey_report", "survey_importance", "survey_scores"):
        with pytest.raises(Stop) as stop:
            catalog.queries()[name](spark, base_dir)
        learner = stop.value.args[0].getStages()[-1]
        assert {k: learner.getOrDefault(k) for k in BOOSTED} == BOOSTED


def test_survey_importance_repeats_as_often_as_the_operator(spark, base_dir, monkeypatch):
    given = []
    model = training.Trained(type("Model", (), {"stages": [None]}), {})
    monkeypatch.setattr(catalog, "survey_training", lambda s, d: (["x"], model))
    monkeypatch.setattr(catalog, "permutation_importance", lambda *a, **k: given.append(
        inspect.signature(permutation_importance).bind(*a, **k)) or spark.createDataFrame([("x", 0.0, 0.0)], "feature string, importance double, deviation double"))
    catalog.survey_importance(spark, base_dir)
    given[0].apply_defaults()
    assert given[0].arguments["repeats"] == 15


# --- scoring ---------------------------------------------------------------

def test_records_in_both_spellings_score_the_same(table, forest):
    scorer = PipelineScorer(forest.model)
    asked = scorer.score(to_request_names(table), ["client_id"]).collect()
    stored = scorer.score(to_stored_names(table), ["client_id"]).collect()
    assert sorted(asked) == sorted(stored)
    for r in asked:
        assert sum(r.probability) == pytest.approx(1) and r.score == r.probability[1]
        assert r.label_text == (ADOPTS if r.prediction == 1 else DECLINES)


def test_light_model_keeps_levels_for_new_rows(spark, table, light, tmp_path):
    scorer, measured = light
    assert measured["auc"] > 0.6
    whole = scorer.score(to_request_names(table), ["client_id"]).collect()
    one = scorer.score(to_request_names(table.filter("client_id = 3")), ["client_id"]).collect()
    assert one[0] in whole
    scorer.save(spark, str(tmp_path / "light"))
    again = LightScorer.load(spark, str(tmp_path / "light")).score(to_request_names(table), ["client_id"])
    assert sorted(again.collect()) == sorted(whole)


def test_light_model_takes_columns_with_many_levels(table):
    data = table.select("client_id", "adesao", "gp_renda", F.concat(F.lit("u"), F.col("client_id")).alias("name"))
    scorer, _ = training.train_light_forest(data, vectors=["name"], **SMALL)
    assert scorer.preparation.vectors == ["name"] and scorer.preparation.features == ["gp_renda_Baixa", "gp_renda_Media"]
    assert scorer.score_table(data, ["client_id"]).count() == data.count()
    columns, _ = training.train_light_forest(data, **SMALL)
    assert columns.preparation.vectors == [] and len(columns.preparation.features) > 30


def test_more_than_a_thousand_levels_never_raise(spark):
    from tabulon.operators.encode import TablePreparation
    data = spark.range(1005).select((F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("v"), F.col("id")).alias("s"))
    fitted = TablePreparation.fit(data, "y")
    assert len(fitted.features) == 1004 and fitted.vectors == []
    assert TablePreparation.fit(data, "y", vectors=["s"]).features == []


def test_light_model_scores_records_payloads_and_table_alike(spark, table, tmp_path):
    columns = ["estado", "gp_renda", "renda", "usa_pix"]
    scorer, _ = training.train_light_forest(table.select("client_id", "adesao", *columns), **SMALL)
    whole = {r.client_id: r.score for r in scorer.score_table(table.select("client_id", *columns), ["client_id"]).collect()}
    for records in (to_request_names(table), to_stored_names(table)):
        got = scorer.score(records, ["client_id"]).collect()
        assert {r.client_id: r.score for r in got} == whole and got[0].unmatched == []
    without = scorer.score(to_request_names(table).drop("renda", "Estado"), ["client_id"]).collect()
    assert without[0].unmatched == ["estado", "renda"]
    median = scorer.preparation.medians["renda"]
    filled = scorer.score_table(table.drop("estado").withColumn("renda", F.lit(median)), ["client_id"]).collect()
    assert {r.client_id: r.score for r in without} == {r.client_id: r.score for r in filled}


def test_light_scorer_walks_flat_trees_to_the_pipelines_scores(table, light):
    scorer = light[0]
    assert scorer.trees is not None
    flat = scorer.score_table(table, ["client_id"])
    assert "MapInArrow" in flat._jdf.queryExecution().optimizedPlan().toString()
    plain = scored(scorer.model, scorer.preparation.transform_new(table, ["client_id"]), ["client_id"])
    assert sorted(flat.drop("unmatched").collect()) == sorted(plain.collect())


def test_choice_of_scorer(spark, forest, light, tmp_path):
    pipeline, lighter = str(tmp_path / "forest"), str(tmp_path / "light")
    with pytest.raises(RuntimeError, match="no model"):
        choose_scorer(spark, lighter, pipeline)
    models.save_model(forest.model, pipeline)
    assert isinstance(choose_scorer(spark, lighter, pipeline), PipelineScorer)
    light[0].save(spark, lighter)
    assert isinstance(choose_scorer(spark, lighter, pipeline), LightScorer)


def test_invalid_records_are_set_apart(spark, table, forest):
    raw = to_request_names(table.select("client_id", *CATEGORIES, *FLAGS))
    raw = raw.withColumn("Usa_pix", F.when(F.col("client_id") == 5, "yes").otherwise(F.col("Usa_pix").cast("string")))
    scores, bad = score_records(PipelineScorer(forest.model), raw, ["client_id"])
    rejected = {r.client_id for r in bad.collect()}
    assert 5 in rejected and 53 in rejected  # broken flag, missing state
    assert scores.count() + len(rejected) == table.count()


def test_export_with_and_without_model(spark, table, forest, tmp_path):
    chosen = training.export_features(spark, table, str(tmp_path / "raw"), str(tmp_path / "no-model"))
    assert read_csv(spark, str(tmp_path / "raw"), chosen.schema).count() == table.count()
    models.save_model(forest.model, str(tmp_path / "m"))
    with_model = training.export_features(
        spark, table, str(tmp_path / "out"), str(tmp_path / "m"), columns=["estado_idx", "prediction"]
    )
    assert read_csv(spark, str(tmp_path / "out"), with_model.schema).columns == ["estado_idx", "prediction"]


def test_stream_scores_each_record_once(spark, table, forest, tmp_path):
    raw = to_request_names(table.select("client_id", *CATEGORIES, *FLAGS)).orderBy("client_id")
    rows = [json.loads(r) for r in raw.toJSON().collect()]
    rows[0].pop("Sexo")
    rows[1]["Usa_pix"] = "many"
    source = tmp_path / "in"
    source.mkdir()

    def drop(name, part):
        (source / name).write_text("\n".join(json.dumps(r) for r in part))

    def drain():
        score_stream(
            read_records(spark, str(source), files_per_trigger=1), PipelineScorer(forest.model),
            str(tmp_path / "scores"), str(tmp_path / "rejects"), str(tmp_path / "checkpoint"),
        ).awaitTermination()
        return (
            spark.read.parquet(str(tmp_path / "scores")).count(),
            spark.read.parquet(str(tmp_path / "rejects")).count(),
        )

    drop("a.json", rows[:50])
    drop("b.json", rows[50:100])
    good, bad = drain()
    assert good + bad == 100 and bad >= 2
    assert drain() == (good, bad)  # nothing new, nothing twice
    drop("c.json", rows[100:])
    good, bad = drain()
    assert good + bad == len(rows)
    batch = {r.client_id: r for r in PipelineScorer(forest.model).score(raw.filter("client_id = 60"), ["client_id"]).collect()}
    streamed = spark.read.parquet(str(tmp_path / "scores")).filter("client_id = '60'").first()
    assert streamed.score == batch[60].score
