"""A training corpus made from `documents`, stage by stage; each stage's rows are written before the next one reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.jaccard import one_of_each
from docflow.llm.linedup import dedup_lines
from docflow.llm.packing import pack, word_bpe_path
from docflow.llm.suffixes import cut_passages
from docflow.llm.toxicity import fit_labels, keep_clean
from docflow.session import work_path


def _with_text(cut: DataFrame, docs: DataFrame, removed: str) -> DataFrame:
    """The columns of `docs` with the new length; a document goes if nothing but white space is left of it."""
    left = cut.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic passages that beat chance; the model is that of the labels that are not held out."""
    return keep_clean(docs, fit_labels(spark, docs, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, up to one edit."""
    return _with_text(dedup_lines(docs), docs, "n_removed")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that stand elsewhere too."""
    return _with_text(cut_passages(docs), docs, "n_removed")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe_path())


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard),
          ("suffix-array dedup", suffix_dedup), ("packing", packing)]
#: No SQL has the segment search, the tokenizer or the curve; tests hold the stages against plain versions.
ORACLE_SQL = None


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
