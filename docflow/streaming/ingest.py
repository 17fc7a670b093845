"""Ingestion of files as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docflow.functions import paths
from docflow.operators.collections import compact_collection, update_collection, write_collection
from docflow.operators.store import BUCKETS
from docflow.plans.embedding import embed_hashed
from docflow.session import remove_path, work_path
from docflow.sources.files import with_contents
from docflow.streaming.landing import landing

#: Files of one batch.
BATCH_FILES = 40_000
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, root: str, glob: str = "*", most: int = BATCH_FILES, index: str | None = None) -> DataFrame:
    """A stream of the files below `root`, each seen once, the oldest first, in batches of at most `most` files.

    Tasks list the files, now and while a stream goes on, and write them to an
    index below `index`, by default the shared folder; the stream's driver
    handles parts of it. A stream that is started again needs the index it had;
    with a `most` below a part's 1,000 files it has one of its own.

    Where `pyarrow.fs` does not know the file system, it is Spark's own stream
    of files, whose driver holds all names.
    """
    files = landing(spark, root, glob, most, index)
    if not files.known():
        name = paths.file_name(F.col("path"))
        found = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(root))
        return found.select(F.col("path").alias("file_path"), name.alias("file_name"), paths.splitext(name).alias("file_extension"),
                            F.col("modificationTime").alias("last_modified"), F.col("length").alias("file_size"), "content")
    files.refresh(spark)
    return with_contents(files.stream(spark, most))


def stream_ingest(files: DataFrame, to_nodes: Callable[[DataFrame], DataFrame], root: str, name: str,
                  checkpoint: str, embed: Callable[[DataFrame], DataFrame] = embed_hashed) -> StreamingQuery:
    """Turn each batch of files into nodes of a collection; node ids make a repeated batch harmless."""
    return (files.writeStream.foreachBatch(
                lambda batch, _: write_collection(to_nodes(batch), root, name, embed=embed))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_update(files: DataFrame, to_docs: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], root: str, name: str,
                  checkpoint: str, embed: Callable[[DataFrame], DataFrame] = embed_hashed, compact_every: int = 20,
                  trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a collection by documents from files as they land: the last file of a document replaces its nodes.

    `to_docs` turns a batch's files into documents; of several in one batch
    that are one document, the one modified last counts. Only the buckets of a
    batch's documents are read. Buckets are compacted every so many batches. A
    batch run again after a failure finds nothing to change.

    A batch's files are opened once and kept in a table while it is worked on.
    """
    def update(batch: DataFrame, number: int) -> None:
        path = work_path(batch.sparkSession, "batch")
        # A batch may have many small splits; in two tasks per core they become as many files.
        batch.coalesce(2 * batch.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
        try:
            update_from(batch.sparkSession.read.schema(batch.schema).parquet(path), number)
        finally:
            remove_path(batch.sparkSession, path)

    def update_from(batch: DataFrame, number: int) -> None:
        docs = to_docs(batch)
        rest = [c for c in docs.columns if c != "doc_id"]
        last = docs.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("last_modified", "file_path")).alias("_d")).select("doc_id", "_d.*")
        update_collection(last, cut, root, name, embed, buckets=buckets)
        if number % compact_every == compact_every - 1:
            compact_collection(batch.sparkSession, root, name)

    return (files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
