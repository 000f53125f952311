"""Training and export jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import quoted
from tabulon.functions.names import CATEGORIES, FLAGS
from tabulon.operators.boosting import Boosted, Boosting, fit as fit_boosted
from tabulon.operators.columns import drop_null, existing, require, select_existing, with_label
from tabulon.operators.encode import TablePreparation, fit_counted_medians, fit_medians, median_filled
from tabulon.operators.importance import permutation_importance
from tabulon.operators.learners import (
    boosted_pipeline, final_features, forest_pipeline, light_forest_pipeline, trees_at_once,
)
from tabulon.operators.metrics import evaluate
from tabulon.operators.scoring import LightScorer
from tabulon.operators.split import hash_split, in_train, stratified_split
from tabulon.operators.statistics import PAGE_COLUMNS
from tabulon.session import scratch_path, shared_dir, task_count
from tabulon.sources.models import load_model, model_exists, save_model, write_metadata
from tabulon.sources.tables import write_csv


#: A learner's task sends sums of every open node, so few tasks with many rows shuffle least; a row
#: takes about ten bytes of memory per tree that grows at the same time.
ROWS_PER_TASK = 500_000
ROW_TREES_PER_TASK = 30_000_000
#: Column of how many equal rows a row stands for.
ROWS = "__rows"


@dataclass
class Trained:
    model: PipelineModel
    metrics: dict[str, float]
    held_out: DataFrame | None = None  # label, prediction and score of the test rows
    held_out_features: DataFrame | None = None  # key, label and features of the test rows
    medians: dict[str, float] | None = None  # what missing numbers take


def with_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", vector_to_array("probability")[1])


def rows_per_task(pipeline: Pipeline) -> int:
    return max(1, min(ROWS_PER_TASK, ROW_TREES_PER_TASK // trees_at_once(pipeline)))


def spread(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows hashed evenly by key, in key order within each partition.

    A learner passes over its rows dozens of times, so one shuffle for an even
    spread pays off, and the same rows in the same places make its seeded
    sampling repeatable.
    """
    tasks = task_count(df.sparkSession, df.count(), rows_per_task)
    return df.repartition(tasks, key).sortWithinPartitions(key)


def fit_and_evaluate(
    train: DataFrame, test: DataFrame, pipeline: Pipeline, key: str, label: str = "label",
    score: Callable[[PipelineModel, DataFrame], DataFrame] | None = None,
) -> Trained:
    """Fit on one part, measure on the other. The learner and the metrics read
    their rows repeatedly, so both are kept; the test rows are scored once, into a checkpoint.
    ``score`` may name a faster way than the model's own to the same prediction and score."""
    shared_dir(train.sparkSession)  # where the learner and the scores leave their checkpoints
    train = spread(train, key, rows_per_task(pipeline)).persist(StorageLevel.MEMORY_AND_DISK)
    model = pipeline.fit(train)
    train.unpersist()
    tested = score(model, test) if score else with_score(model.transform(test))
    tested = tested.select(label, F.col("prediction").cast("double"), "score").checkpoint()
    return Trained(model, evaluate(tested, label, "prediction", "score"), tested, test)


def evenly(df: DataFrame, key: str) -> DataFrame:
    """The rows kept for several passes, dealt to all cores: a table that comes from joins lies in
    partitions of many bytes, which are too many rows to score in a task."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, quoted(key)).persist(StorageLevel.MEMORY_AND_DISK)


def train_forest(
    clients: DataFrame,
    target: str = "adesao",
    key: str = "client_id",
    categories: Sequence[str] = CATEGORIES,
    numbers: Sequence[str] = FLAGS,
    **settings,
) -> Trained:
    """The adoption forest on an 80/20 split by key; unlabelled rows are left out."""
    require(clients, [target, key, *categories, *numbers])
    rows = drop_null(with_label(clients.select(*[quoted(c) for c in (key, target, *categories, *numbers)]), target), "label")
    rows = evenly(rows, key)
    train, test = hash_split(rows, key)
    trained = fit_and_evaluate(train, test, forest_pipeline(categories, numbers, **settings), key)
    rows.unpersist()
    return trained


def save_training(
    spark: SparkSession,
    trained: Trained,
    model_path: str,
    metadata_path: str,
    categories: Sequence[str] = CATEGORIES,
    numbers: Sequence[str] = FLAGS,
) -> None:
    forest = trained.model.stages[-1]
    save_model(trained.model, model_path)
    write_metadata(
        spark, metadata_path, categories, numbers, final_features(categories, numbers), trained.metrics,
        num_trees=forest.getNumTrees, max_depth=forest.getOrDefault("maxDepth"),
    )


def train_light_forest(
    features: DataFrame, target: str = "adesao", key: str = "client_id", fit_on: str = "train",
    vectors: Sequence[str] = (), **settings
) -> tuple[LightScorer, dict[str, float]]:
    """The lighter forest on one-hot and median-filled columns.

    Text columns named in ``vectors`` are encoded as sparse vectors, the others as
    a column per level. Levels and medians come from the training rows; ``fit_on="all"`` takes them
    from the whole table, hold-out included.
    """
    rows = evenly(drop_null(require(features, [target, key]), target), key)
    train, test = hash_split(rows, key)
    source = train if fit_on == "train" else rows
    preparation = TablePreparation.fit(source.drop(key), target, vectors=vectors)

    def prepared(part):
        return preparation.transform_new(part, [key, target]).withColumnRenamed(target, "label").withColumn(
            "label", F.col("label").cast("double")
        )

    pipeline = light_forest_pipeline(preparation.features, preparation.vectors, **settings)
    trained = fit_and_evaluate(
        prepared(train), prepared(test), pipeline, key,
        score=lambda model, part: LightScorer(preparation, model).score_prepared(part, ["label"]),
    )
    rows.unpersist()
    return LightScorer(preparation, trained.model), trained.metrics


def train_boosted(
    rows: DataFrame, features: Sequence[str], target: str, key: str,
    validation_percent: int = 10, stratified: bool = False, **settings,
) -> Trained:
    """Boosted trees; a tenth of the training rows decides when to stop. The test
    rows come by a hash of the key, or ``stratified`` a fifth of each label.

    Spark's trees take no missing numbers, so these get the training median.
    """
    table = drop_null(rows, target).select(
        quoted(key), quoted(target).cast("double").alias("label"), *[quoted(f).cast("double").alias(f) for f in features]
    )
    # the split hashes every key and the medians take several passes, so the split rows are kept
    if stratified:
        kept = stratified_split(table, "label", key).persist(StorageLevel.MEMORY_AND_DISK)
        train, test = (kept.filter(c).drop("in_test") for c in ("not in_test", "in_test"))
    else:
        kept = table.persist(StorageLevel.MEMORY_AND_DISK)
        train, test = hash_split(kept, key)
    # no tree can tell equal rows apart, so the learner gets each different row once, with its number as weight
    counted = train.withColumn("held_out", ~in_train(quoted(key), 100 - validation_percent, seed=43)).groupBy(
        "label", "held_out", *[quoted(f) for f in features]).agg(F.count(F.lit(1)).cast("double").alias(ROWS)).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = fit_counted_medians(counted, features, ROWS)
    if fitted is None:
        fitted = fit_medians(train, features)
    train, test = median_filled(counted, fitted), median_filled(test, fitted)
    # the key of a row that stands for others comes from its content
    train = train.withColumn(key, F.xxhash64("label", "held_out", *[quoted(f) for f in features]))
    test = test.withColumn("held_out", F.lit(False))
    trained = fit_and_evaluate(train, test, boosted_pipeline(features, validation="held_out", weight=ROWS, **settings), key)
    trained.medians = fitted
    counted.unpersist()
    kept.unpersist()
    return trained


def train_survey(
    rows: DataFrame, features: Sequence[str], target: str, key: str, validation_percent: int = 10,
    learner: Boosting = Boosting(),
) -> tuple[Boosted, DataFrame]:
    """The penalised boosted trees on a stratified split, and the test rows. Missing numbers stay
    missing; a tenth of the training rows decides when to stop."""
    table = drop_null(rows, target).select(
        quoted(key), quoted(target).cast("double").alias("label"), *[quoted(f).cast("double").alias(f) for f in features])
    # the split, the bins, the scores and the importance read the rows again and again, few of their columns at a time
    path = scratch_path(rows.sparkSession, "survey-rows")
    table.write.parquet(path)
    marked = stratified_split(rows.sparkSession.read.schema(table.schema).parquet(path), "label", key)
    train, test = (marked.filter(c).drop("in_test") for c in ("not in_test", "in_test"))
    train = train.withColumn("held_out", ~in_train(quoted(key), 100 - validation_percent, seed=43))
    return fit_boosted(train, features, "label", "held_out", learner), test


def survey_job(spark: SparkSession, rows: DataFrame, features: Sequence[str], target: str, key: str, path: str,
               learner: Boosting = Boosting(), repeats: int = 15) -> None:
    """One run of the survey model: train, save, score the test rows, and take importance. The
    model goes to ``path``/model, test rows with their scores to ``path``/scores, importance to
    ``path``/importance."""
    model, test = train_survey(rows, features, target, key, learner=learner)
    model.save(spark, f"{path}/model")
    scorer = Boosted.load(spark, f"{path}/model").scorer()
    scorer.scored(test, [key, "label"]).write.mode("overwrite").parquet(f"{path}/scores")
    permutation_importance(scorer, test, features, key, repeats=repeats).write.mode("overwrite").parquet(f"{path}/importance")


def export_features(
    spark: SparkSession,
    table: DataFrame,
    out_path: str,
    model_path: str | None = None,
    columns: Sequence[str] = PAGE_COLUMNS,
) -> DataFrame:
    """Write the chosen columns of the transformed table as CSV.

    Without a saved model the raw columns are written; a failing model is an
    error rather than a silent fallback.
    """
    if model_path and model_exists(spark, model_path):
        transformed = load_model(model_path).transform(table)
        chosen = select_existing(transformed if existing(transformed, columns) else table, columns)
    else:
        chosen = select_existing(table, columns)
    write_csv(chosen, out_path)
    return chosen
