"""Ingestion jobs: rules, chunks, vectors, collection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from docflow.operators.chunk import chunk_words, with_lineage
from docflow.operators.collections import write_collection
from docflow.operators.rules import rule_condition
from docflow.plans.embedding import embed_hashed
from docflow.plans.tasks import TaskLog

Step = Callable[[DataFrame], DataFrame]


class Source(Protocol):
    """Where documents come from. `documents` has a doc_id, the rules' key and a text column."""

    rule_key: str

    def documents(self, spark: SparkSession) -> DataFrame: ...


def cut_nodes(docs: DataFrame) -> DataFrame:
    """Documents cut into nodes. The text takes part in the id, so a changed chunk is a new node."""
    return with_lineage(chunk_words(docs, 512, 20), parts=("chunk_no", "text"))


def fold(df: DataFrame, steps: list[Step]) -> DataFrame:
    return reduce(lambda frame, step: frame.transform(step), steps, df)


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each stage, all counted in one pass; a stage needs all earlier ones."""
    counts, passed = [], F.lit(True)
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append((name, F.count_if(passed)))
    row = df.agg(*[count.alias(f"c{i}") for i, (_, count) in enumerate(counts)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"c{i}").alias("n"))
        for i, (name, _) in enumerate(counts)])))


def run_ingest(spark: SparkSession, source: Source, sink: Callable[[DataFrame], None], log: TaskLog, task_id: str,
               include: list[str] = (), exclude: list[str] = (), nodes: Step = cut_nodes) -> None:
    """Load, filter and cut documents and hand the nodes to the sink; the log gets start, counts and DONE or ERROR.

    The counts are observed while the sink runs the frame, so nothing is read
    twice. The sink has to run it.
    """
    with log.task(task_id) as task:
        docs, cut = Observation(), Observation()
        loaded = source.documents(spark)
        ruled = loaded.withColumn("_keep", rule_condition(F.col(source.rule_key), include, exclude)).observe(
            docs, F.count(F.lit(1)).alias("loaded"), F.count_if("_keep").alias("filtered"))
        sink(nodes(ruled.filter("_keep").drop("_keep")).observe(cut, F.count(F.lit(1)).alias("nodes")))
        task.stages({**docs.get, **cut.get})


def collection_sink(root: str, name: str, unique: bool = False, embed: Step = embed_hashed) -> Callable[[DataFrame], None]:
    """A sink that embeds the nodes a collection lacks and adds them."""
    return lambda nodes: write_collection(nodes, root, name, unique, embed)
