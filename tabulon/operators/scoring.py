"""Scoring tables of prepared rows, raw records and free payloads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import prediction_text, quoted
from tabulon.functions.names import NAMES, to_table_names
from tabulon.operators.columns import accepted, validated
from tabulon.operators.encode import TablePreparation
from tabulon.operators.trees import TreeScorer, saved_scorer, stage_scorer
from tabulon.sources.models import load_model, model_exists, save_model


def scored(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """The kept columns with the predicted class, class probabilities as a
    plain array, the probability of class 1, and the class text. ``tasks`` spreads
    rows that lie in fewer partitions than their scoring is worth."""
    out = model.transform(df.repartition(tasks) if tasks else df).withColumn("probabilities", vector_to_array("probability"))
    return out.select(
        *[quoted(k) for k in keep],
        F.col("prediction").cast("int").alias("prediction"),
        F.col("probabilities").alias("probability"),
        F.col("probabilities")[1].alias("score"),
        prediction_text(F.col("prediction")).alias("label_text"),
    )


@dataclass
class PipelineScorer:
    """The indexed-category pipeline applied to client records."""

    model: PipelineModel

    def score(self, records: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        return scored(self.model, to_table_names(records, tuple(keep)), keep, tasks)


@dataclass
class FlatScorer:
    """The indexed-category pipeline with its trees as one flat table, which is faster to load
    and to score than the pipeline and gives the same figures. Scores tables and records."""

    indexer: PipelineModel
    trees: TreeScorer

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatScorer:
        """From a saved pipeline of an indexer, an assembler of number columns and tree learner."""
        stages = spark.read.json(f"{path}/stages/*/metadata").select(
            F.col("class").alias("kind"), "uid", "paramMap", F.input_file_name().alias("file")).collect()
        folder = {r["kind"].rsplit(".", 1)[-1]: r["file"].rsplit("/metadata/", 1)[0] for r in stages}
        inputs = {r["kind"].rsplit(".", 1)[-1]: r["paramMap"] for r in stages}
        learner = next((k for k in folder if k.endswith("ClassificationModel")), None)
        if learner is None or "VectorAssembler" not in folder or "StringIndexerModel" not in folder:
            raise ValueError("the pipeline has no indexer, assembler and tree learner")
        names = list(inputs["VectorAssembler"]["inputCols"])
        trees = saved_scorer(spark, folder[learner], learner, names)
        return cls(PipelineModel([StringIndexerModel.load(folder["StringIndexerModel"])]), trees)

    def score_table(self, df: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        return self.trees.scored(self.indexer.transform(df), keep, tasks)

    def score(self, records: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        return self.score_table(to_table_names(records, tuple(keep)), keep, tasks)


@dataclass
class LightScorer:
    """The one-hot model applied to client records, also incomplete ones.

    Records keep the columns that are no model inputs under either spelling, such
    as the income. ``unmatched`` in the result lists the training columns that the
    records lack.
    """

    preparation: TablePreparation
    model: PipelineModel
    saved: str | None = None  # where the model lies, if it was loaded

    @cached_property
    def trees(self) -> TreeScorer | None:
        """The trees as one flat table, which gives the pipeline's figures in less time. None if the
        pipeline encodes vectors itself or is to complain of a number that has no median."""
        if self.preparation.vectors or None in self.preparation.medians.values():
            return None
        learner, spark = self.model.stages[-1], SparkSession.active()
        if self.saved is None:
            return stage_scorer(spark, learner, self.preparation.features)
        count = len(self.model.stages)
        folder = PipelineSharedReadWrite.getStagePath(learner.uid, count - 1, count, f"{self.saved}/stages")
        return saved_scorer(spark, folder, type(learner).__name__, self.preparation.features)

    def score(self, records: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        lacking = [table for asked, (stored, table) in NAMES.items() if not {asked, stored} & set(records.columns)]
        return self.score_table(to_table_names(records, tuple(keep), others=True).drop(*lacking), keep, tasks)

    def score_table(self, df: DataFrame, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
        unmatched = F.array(*[F.lit(c) for c in self.preparation.unmatched(df)]).cast("array<string>")
        # dealt while a row is narrow: a column per level makes it several times as wide
        rows = self.preparation.transform_new(df.repartition(tasks) if tasks else df, keep)
        return self.score_prepared(rows, keep).withColumn("unmatched", unmatched)

    def score_prepared(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Scores of rows that are aligned training features already, beside the kept columns."""
        return self.trees.scored(rows, keep) if self.trees else scored(self.model, rows, keep)

    def save(self, spark: SparkSession, path: str) -> None:
        self.preparation.save(spark, f"{path}/preparation")
        save_model(self.model, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LightScorer:
        return cls(TablePreparation.load(spark, f"{path}/preparation"), load_model(f"{path}/model"), f"{path}/model")


def choose_scorer(
    spark: SparkSession, light_path: str | None = None, pipeline_path: str | None = None
) -> LightScorer | PipelineScorer:
    """The lighter model if configured and present, else the pipeline."""
    if light_path and model_exists(spark, f"{light_path}/model"):
        return LightScorer.load(spark, light_path)
    if pipeline_path and model_exists(spark, pipeline_path):
        return PipelineScorer(load_model(pipeline_path))
    raise RuntimeError("no model available: neither path holds a saved model")


def score_records(
    scorer: LightScorer | PipelineScorer | FlatScorer, raw: DataFrame, keep: Sequence[str] = (), tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scores of the valid records, and the invalid ones with their reasons."""
    checked = validated(raw)
    return scorer.score(accepted(checked), keep, tasks), checked.filter(F.size("reject_reason") > 0)
