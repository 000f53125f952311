"""Work per row and per task of training and scoring."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions.names import CATEGORIES, FLAGS, to_request_names
from tabulon.operators import boosting, scoring
from tabulon.operators.learners import boosted_pipeline, forest_pipeline, light_forest_pipeline
from tabulon.operators.scoring import PipelineScorer, score_records, scored
from tabulon.plans import catalog, training
from tabulon.session import task_count
from tabulon.sources.tables import clients
from tabulon.streaming.scoring import read_records, score_stream

SMALL = {"numTrees": 4, "maxDepth": 4}


@pytest.fixture(scope="module")
def table(spark, base_dir):
    return clients(spark, base_dir).coalesce(1).persist()


@pytest.fixture(scope="module")
def forest(table):
    return training.train_forest(table, **SMALL)


def parts(df):
    return df.rdd.getNumPartitions()


def test_light_forest_steps_once_a_level_and_is_the_same(table):
    columns = ["client_id", "adesao", "gp_renda", "renda", "usa_pix"]
    assert light_forest_pipeline(["x"]).getStages()[-1].getCacheNodeIds()
    walked, stepped = (training.train_light_forest(table.select(*columns), cacheNodeIds=c, **SMALL)[0].model.stages[-1] for c in (False, True))
    assert walked.toDebugString.split("\n")[1:] == stepped.toDebugString.split("\n")[1:]


def test_a_learners_tasks_hold_many_rows():
    found = [training.rows_per_task(p) for p in (light_forest_pipeline(["x"]), forest_pipeline(), boosted_pipeline(["x"]))]
    assert found == [300_000, 100_000, 500_000]


def test_a_learners_tasks_come_in_whole_rounds_of_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [task_count(spark, n, 10) for n in (0, 10 * cores, 10 * cores + 1, 25 * cores)] == [cores, cores, 2 * cores, 3 * cores]


def test_light_hold_out_is_scored_by_flat_trees_as_by_the_pipeline(table, monkeypatch):
    features = table.select("client_id", "adesao", "gp_renda", "renda", "usa_pix")

    def caught(rows):
        raise AssertionError("the pipeline scored the hold-out")

    with monkeypatch.context() as patch:
        patch.setattr(training, "with_score", caught)
        scorer, found = training.train_light_forest(features, **SMALL)
    test = training.hash_split(training.drop_null(features, "adesao"), "client_id")[1]
    plain = scored(scorer.model, scorer.preparation.transform_new(test, ["adesao"]), ["adesao"])
    rows = plain.select(F.col("adesao").cast("double").alias("label"), F.col("prediction").cast("double"), "score")
    assert found == training.evaluate(rows, "label", "prediction", "score")


def test_light_scorer_deals_its_rows_before_they_are_wide(table):
    scorer, _ = training.train_light_forest(table.select("client_id", "adesao", *catalog.LIGHT_COLUMNS), **SMALL)
    dealt = scorer.score_table(table, ["client_id"], 5)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert parts(dealt) == 5 and "__f" not in plan[plan.index("Repartition"):]


def test_a_loaded_light_scorer_reads_its_trees_where_they_are_saved(spark, table, monkeypatch, tmp_path):
    scorer, _ = training.train_light_forest(table.select("client_id", "adesao", *catalog.LIGHT_COLUMNS), **SMALL)
    whole = sorted(scorer.score_table(table, ["client_id"]).collect())
    scorer.save(spark, str(tmp_path / "light"))

    def caught(*a):
        raise AssertionError("the trees were saved again")

    monkeypatch.setattr(scoring, "stage_scorer", caught)
    loaded = scoring.LightScorer.load(spark, str(tmp_path / "light"))
    assert sorted(loaded.score_table(table, ["client_id"]).collect()) == whole


def test_hold_out_of_one_partition_is_scored_by_all_cores(spark, forest):
    assert parts(forest.held_out) >= spark.sparkContext.defaultParallelism


def test_hold_out_is_scored_once(spark, forest):
    plan = forest.held_out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan


def test_scorers_spread_their_rows(spark, table, forest):
    raw = to_request_names(table.select("client_id", *CATEGORIES, *[F.col(f).cast("string") for f in FLAGS]))
    assert parts(scored(forest.model, table, ["client_id"], 5)) == 5
    assert parts(score_records(PipelineScorer(forest.model), raw, ["client_id"], 5)[0]) == 5
    assert parts(scored(forest.model, table, ["client_id"])) == 1


@pytest.mark.parametrize("query", ["light_forest_metrics", "choose_scorer", "score_payloads"])
def test_light_queries_score_by_all_cores(spark, base_dir, monkeypatch, query):
    class Seen(Exception):
        pass

    class Scorer:
        def score_table(self, df, keep=(), tasks=None):
            raise Seen(tasks)

        score = score_table

    monkeypatch.setattr(catalog, "light_model", lambda *a: "light")
    monkeypatch.setattr(catalog, "forest_model", lambda *a: "forest")
    monkeypatch.setattr(catalog.LightScorer, "load", lambda *a: Scorer())
    monkeypatch.setattr(catalog, "choose_scorer", lambda *a, **k: Scorer())
    with pytest.raises(Seen) as seen:
        catalog.queries()[query](spark, base_dir)
    assert seen.value.args == (spark.sparkContext.defaultParallelism,)


@pytest.mark.parametrize("query", ["forest_metrics", "model_save_load"])
def test_forest_queries_score_by_all_cores(spark, base_dir, monkeypatch, query):
    class Seen(Exception):
        pass

    def seen(model, df, keep=(), tasks=None):
        raise Seen(tasks)

    monkeypatch.setattr(catalog, "forest_model", lambda *a: "forest")
    monkeypatch.setattr(catalog, "load_model", lambda *a: None)
    monkeypatch.setattr(catalog, "save_model", lambda *a: None)
    monkeypatch.setattr(catalog, "scored", seen)
    with pytest.raises(Seen) as caught:
        catalog.queries()[query](spark, base_dir)
    assert caught.value.args == (spark.sparkContext.defaultParallelism,)


def test_a_stream_of_one_file_is_scored_by_all_cores(spark, table, forest, tmp_path):
    raw = to_request_names(table.select("client_id", *CATEGORIES, *FLAGS))
    raw.coalesce(1).write.json(str(tmp_path / "in"))
    given = []

    class Scorer(PipelineScorer):
        def score(self, records, keep=(), tasks=None):
            given.append(tasks)
            return super().score(records, keep, tasks)

    score_stream(read_records(spark, str(tmp_path / "in")), Scorer(forest.model), str(tmp_path / "scores"), str(tmp_path / "rejects"),
                 str(tmp_path / "checkpoint")).awaitTermination()
    assert given == [spark.sparkContext.defaultParallelism]


def test_boosting_keeps_its_split_rows(spark, base_dir, monkeypatch):
    class Stop(Exception):
        pass

    def caught(train, test, pipeline, key, label="label"):
        raise Stop(*[d._jdf.queryExecution().withCachedData().toString() for d in (train, test)])

    monkeypatch.setattr(training, "fit_and_evaluate", caught)
    with pytest.raises(Stop) as stop:
        catalog.boosted_metrics(spark, base_dir)
    spark.catalog.clearCache()
    assert all("InMemoryRelation" in plan for plan in stop.value.args)


def test_a_pass_walks_only_the_growing_tree(spark, monkeypatch):
    rows = spark.range(2_000).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"),
                                     ((F.col("id") % 40 > 20) != (F.col("id") % 7 == 1)).cast("int").alias("y"))
    asked, plain = [], boosting.histograms

    def seen(rows, *rest):
        asked.append(rows.agg(F.max(F.abs("margin"))).first()[0])
        return plain(rows, *rest)

    monkeypatch.setattr(boosting, "histograms", seen)
    model = boosting.fit(rows, ["x", "z"], "y", settings=boosting.Boosting(rounds=3, max_leaves=2))
    added = max(abs(r["value"][0]) for r in model.rows if r["tree"] == 0 and r["left"] < 0)
    assert asked[0] == 0 and added in [pytest.approx(a) for a in asked]  # the first tree is in the margins of the second round


def test_forest_steps_once_a_level():
    assert forest_pipeline().getStages()[-1].getCacheNodeIds()


def test_boosted_trees_step_once_a_level():
    assert boosted_pipeline(["x"]).getStages()[-1].getCacheNodeIds()
