"""Validate and score a stream of client records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tabulon.operators.columns import accepted, rejected, validated
from tabulon.operators.scoring import LightScorer, PipelineScorer
from tabulon.sources.records import RAW_RECORD_SCHEMA


def read_records(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """New JSON files as they arrive, every field as unchecked text; the text of
    a line that is no JSON is kept in ``_corrupt_record``."""
    return (
        spark.readStream.schema(StructType([*RAW_RECORD_SCHEMA.fields, StructField("_corrupt_record", StringType())]))
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def score_stream(
    records: DataFrame,
    scorer: LightScorer | PipelineScorer,
    scores_path: str,
    rejects_path: str,
    checkpoint_path: str,
    key: str = "client_id",
) -> StreamingQuery:
    """Start a query that drains what has arrived and then stops.

    Each micro-batch is validated once and written to two places below a folder
    named after the batch, so a batch repeated after a failure replaces its own
    output and no record appears twice. The checkpoint remembers the files read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validated(batch).persist()
        tasks = records.sparkSession.sparkContext.defaultParallelism  # files may be few and hold many records
        scorer.score(accepted(checked), [key], tasks).write.mode("overwrite").parquet(f"{scores_path}/batch={batch_id}")
        rejected(checked).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        checked.unpersist()

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
