"""Questions in, documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.operators.collections import open_collection
from docflow.operators.similarity import BATCH_BYTES, top_k
from docflow.plans.embedding import embed_hashed


def search(questions: DataFrame, nodes: DataFrame, k: int = 2, metric: str = "cosine", *,
           question_id: str = "item_id", question: str = "text", embed: Callable[[DataFrame], DataFrame] = embed_hashed,
           carry: list[str] = (), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Best nodes per question: (query_id, rank, node_id, score, *carry).

    The nodes are embedded already; `embed` does the same for the `text` of the questions.
    """
    asked = embed(questions.select(F.col(question_id).alias("query_id"), F.col(question).alias("text")))
    return top_k(asked, nodes, k, metric, carry=carry, batch_bytes=batch_bytes)


def search_collection(spark: SparkSession, root: str, name: str, questions: DataFrame, k: int = 2, metric: str = "cosine", **how) -> DataFrame:
    """`search` among the nodes of a collection, with the vectors they were stored with; nothing but the questions is embedded."""
    return search(questions, open_collection(spark, root, name), k, metric, **how)


def attach(hits: DataFrame, nodes: DataFrame, columns: list[str], node_id: str = "node_id") -> DataFrame:
    """Hits with wide columns of their nodes, such as texts; narrow ones travel cheaper by `carry`.

    The hits go to the nodes, which are not shuffled as long as the hits are few.
    """
    wanted = nodes.select(F.col(node_id).alias("node_id"), *columns)
    return wanted.join(hits.select("query_id", "rank", "node_id", "score"), "node_id")
