"""Index codes of text columns with any number of levels, as a saved stage that joins."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import quoted
from tabulon.operators.bounded import join_small, numbered, pinned
from tabulon.operators.learners import FOREST
from tabulon.operators.scoring import scored
from tabulon.sources.models import load_model, save_model


@dataclass
class LevelIndex:
    """Levels of each column with their code, by falling frequency and then by name, in a written
    table. Null and unseen values get the code after the last level. No level passes the driver
    unless a column's levels are few enough to be broadcast."""

    spark: SparkSession
    path: str
    columns: list[str]
    suffix: str = "_idx"

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], path: str, suffix: str = "_idx") -> LevelIndex:
        spark = df.sparkSession
        cells = df.select(*[quoted(c).cast("string").alias(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "level")
        counts = cells.where("level is not null").groupBy("column", "level").agg(F.count(F.lit(1)).alias("rows"))
        placed = numbered(counts, [F.asc("column"), F.desc("rows"), F.asc("level")], "place")
        first = F.broadcast(placed.groupBy("column").agg(F.min("place").alias("first")))  # a row per column
        codes = placed.join(first, "column").select("column", "level", (F.col("place") - F.col("first")).alias("code"))
        codes.write.mode("overwrite").partitionBy("column").parquet(f"{path}/levels")
        spark.createDataFrame([(json.dumps([list(columns), suffix]),)], "value string").write.mode("overwrite").text(f"{path}/state")
        return cls(spark, path, list(columns), suffix)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LevelIndex:
        columns, suffix = json.loads(spark.read.text(f"{path}/state").first()[0])
        return cls(spark, path, columns, suffix)

    def levels(self, column: str) -> DataFrame:
        table = self.spark.read.schema("level string, code long, column string").parquet(f"{self.path}/levels")
        return table.where(F.col("column") == column).select("level", "code")

    def transform(self, df: DataFrame) -> DataFrame:
        for column in self.columns:
            out = column + self.suffix
            levels = self.levels(column)
            last = float(levels.count())
            codes = pinned(levels.select(F.col("level").alias("__level"), F.col("code").cast("double").alias(out)))
            df = join_small(df.withColumn("__level", quoted(column).cast("string")), codes, ["__level"], "left")
            df = df.drop("__level").withColumn(out, F.coalesce(quoted(out), F.lit(last)))
        return df


def one_hot_levels(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """The column's one-hot as a sparse vector with an entry per sorted level, for any number of
    levels: codes by a join, so that the driver holds none. Null is all zeros."""
    out = out or f"{column}_onehot"
    levels = df.select(quoted(column).cast("string").alias("__level")).where("__level is not null").distinct()
    codes = numbered(levels, [F.asc("__level")], "__code")
    size = codes.count()
    coded = join_small(df.withColumn("__level", quoted(column).cast("string")), codes, ["__level"], "left")
    # one more value than levels, the last one, which stands for none and is dropped
    kind = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
    coded = coded.withColumn("__code", F.coalesce(F.col("__code"), F.lit(size)).cast("double")).withMetadata("__code", kind)
    return OneHotEncoder(inputCols=["__code"], outputCols=[out], dropLast=True).fit(coded).transform(coded).drop("__code", "__level")


@dataclass
class IndexedForest:
    """A forest on joined codes, read as numbers, so that a column may have more levels than
    bins, or than the driver could list."""

    index: LevelIndex
    model: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, categories: Sequence[str], numbers: Sequence[str], path: str, label: str = "label", **settings) -> IndexedForest:
        index = LevelIndex.fit(df, categories, f"{path}/index")
        inputs = [*[c + index.suffix for c in categories], *numbers]
        forest = RandomForestClassifier(labelCol=label, featuresCol="features", **{**FOREST, **settings})
        model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), forest]).fit(index.transform(df))
        save_model(model, f"{path}/model")
        return cls(index, model)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IndexedForest:
        return cls(LevelIndex.load(spark, f"{path}/index"), load_model(f"{path}/model"))

    def score_table(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return scored(self.model, self.index.transform(df), keep)
