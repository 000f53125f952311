"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Only settings the engine's plans rely on. Parallelism (executors, shuffle
# partitions, memory) is left to whoever submits the job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app_name: str = "tabulon", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def task_count(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for a shuffle whose rows are few by bytes but costly to work on: one
    per core, and as many as the rows need, in whole rounds of the cores, as a last
    round of a few tasks takes as long as a full one. Naming a count keeps AQE from
    merging such partitions."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-rows // (rows_per_task * cores)))


# Temporary folders of local sessions; each goes when the process ends.
_own_folders: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, also used for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    that setting gets a temporary folder; a cluster session without it is an
    error, since a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if configured is None:
        own = tempfile.TemporaryDirectory(prefix="tabulon-", ignore_cleanup_errors=True)
        _own_folders.append(own)
        configured = own.name
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
