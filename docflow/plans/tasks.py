"""A task log as an append-only table."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.schema import TASK_LOG

STARTED, DONE, ERROR = "STARTED", "DONE", "ERROR"


class TaskLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, task_id: str, status: str, stages: dict[str, int] | None = None, error: str | None = None) -> None:
        """Append one entry, or one per stage with its row count."""
        at = datetime.now(timezone.utc)
        rows = [(task_id, status, stage, n, at, error) for stage, n in (stages or {None: None}).items()]
        self.spark.createDataFrame(rows, TASK_LOG).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(TASK_LOG).parquet(self.path)

    @contextmanager
    def task(self, task_id: str):
        """Log start and DONE, or ERROR with the message before raising it again."""
        self.add(task_id, STARTED)
        try:
            yield _Task(self, task_id)
        except Exception as error:
            self.add(task_id, ERROR, error=str(error))
            raise
        self.add(task_id, DONE)


class _Task:
    def __init__(self, log: TaskLog, task_id: str):
        self.log, self.task_id = log, task_id

    def stages(self, rows: dict[str, int]) -> None:
        self.log.add(self.task_id, STARTED, rows)


def task_status(log: DataFrame, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Latest status, number of entries and elapsed seconds per task, from partial aggregates."""
    at = F.col(order[0])
    seconds = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1_000_000
    return log.groupBy("task_id").agg(
        F.max_by("status", F.struct(*order)).alias("status"), F.count("*").alias("n_entries"),
        seconds.alias("elapsed_s"))
