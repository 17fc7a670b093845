"""Jobs that keep a collection as its source is: what was added, changed or removed there, and nothing else, is worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.operators.chunk import chunk_sentences, with_lineage
from docflow.operators.collections import sync_listing, update_collection
from docflow.operators.rules import SUPPORTED_EXTENSIONS, rule_condition
from docflow.operators.store import BUCKETS
from docflow.plans.embedding import embed_hashed
from docflow.plans.ingest import Source, Step
from docflow.plans.tasks import TaskLog
from docflow.sources.files import Readers, extract_text, list_files, read_paths


def cut_sentences(docs: DataFrame) -> DataFrame:
    """Documents cut into nodes of whole sentences, 512 words at most."""
    return with_lineage(chunk_sentences(docs, 512, 20), parts=("chunk_no", "text"))


def run_sync(spark: SparkSession, source: Source, root: str, name: str, log: TaskLog, task_id: str, include: list[str] = (),
             exclude: list[str] = (), *, cut: Step = cut_sentences, embed: Step = embed_hashed, scope: str = "",
             complete: bool = True, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring a collection up to date with a source; the log gets start, counts and DONE or ERROR.

    Documents that the rules leave out are as good as not there. With `complete`
    the source returns all its documents, and the others of its `scope` are removed.
    """
    with log.task(task_id) as task:
        docs = source.documents(spark).filter(rule_condition(F.col(source.rule_key), include, exclude))
        counts = update_collection(docs, cut, root, name, embed, scope=scope, complete=complete, buckets=buckets)
        task.stages(counts)
    return counts


def sync_folder(spark: SparkSession, folder: str, root: str, name: str, *, cut: Step = cut_sentences, embed: Step = embed_hashed,
                key: Callable[[Column], Column] = lambda path: path, extensions: list[str] = SUPPORTED_EXTENSIONS,
                condition: Column | None = None, readers: Readers | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring a collection up to date with the files below a folder, which is its scope; returns the counts of `sync_listing`.

    Tasks list the files with their time and size, and only new and changed ones
    are read; what is no longer listed is removed. `key` makes a file's
    identity from its path, and the document's id is a hash of that. A file
    without a readable text has no nodes until it changes.
    """
    listed = list_files(spark, folder).filter(F.col("file_extension").isin(*extensions))
    if condition is not None:
        listed = listed.filter(condition)
    doc_id = F.sha2(key(F.col("file_path")), 256)
    listing = listed.select(doc_id.alias("doc_id"), "file_path", F.concat_ws(
        "#", "file_path", F.unix_micros("last_modified"), "file_size").alias("doc_hash"))

    def load(changed: DataFrame | None) -> DataFrame:
        wanted = listing if changed is None else changed
        return extract_text(read_paths(spark, wanted), readers=readers).withColumn("doc_id", doc_id)

    return sync_listing(listing, load, cut, root, name, scope=folder, complete=True, embed=embed, buckets=buckets)
