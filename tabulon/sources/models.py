"""Saved models and their metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

# The fields of a model's metadata.
METADATA_SCHEMA = (
    "categorical_cols array<string>, numeric_cols array<string>, final_features array<string>, "
    "metrics map<string, double>, model_type string, num_trees int, max_depth int"
)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether a saved model lies at the path, on any file system."""
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata")
        return True
    except AnalysisException:
        return False


def write_metadata(
    spark: SparkSession,
    path: str,
    categories: Sequence[str],
    numbers: Sequence[str],
    features: Sequence[str],
    metrics: Mapping[str, float],
    model_type: str = "RandomForestClassifier",
    num_trees: int = 300,
    max_depth: int = 10,
) -> None:
    row = (list(categories), list(numbers), list(features), dict(metrics), model_type, num_trees, max_depth)
    spark.createDataFrame([row], METADATA_SCHEMA).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata row, or no row when the path cannot be read."""
    try:
        return spark.read.schema(METADATA_SCHEMA).json(path)
    except AnalysisException:
        return spark.createDataFrame([], METADATA_SCHEMA)


def metadata_dict(spark: SparkSession, path: str) -> dict:
    row = read_metadata(spark, path).first()
    return row.asDict(recursive=True) if row else {}
