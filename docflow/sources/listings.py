"""Landed listings of repositories and drives, joined with the landed contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import paths
from docflow.functions.text import strict_utf8
from docflow.operators.quality import good, quarantine
from docflow.sources.files import Readers, decode_results, with_error


def _with_names(entries: DataFrame) -> DataFrame:
    return entries.withColumn("file_extension", paths.file_extension(F.col("file_name")))


def land_contents(blobs: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write contents (path, content) as a table in buckets of their path, so that listings can be joined where they lie."""
    writer = blobs.repartition(buckets, "path").write.mode("overwrite").bucketBy(buckets, "path").sortBy("path")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def with_content(entries: DataFrame, blobs: DataFrame, buckets: int | None = None) -> DataFrame:
    """All entries with their content; `_error` on those whose content never arrived.

    If `blobs` is a table that `land_contents` wrote in so many `buckets`, only
    the entries are moved, and no content.
    """
    if buckets is not None:
        entries = entries.repartition(buckets, "file_path")
    content = blobs.select(F.col("path").alias("file_path"), F.struct("content").alias("_blob"))
    joined = entries.join(content, "file_path", "left")
    return joined.select(*entries.columns, F.col("_blob.content").alias("content"),
                         F.when(F.col("_blob").isNull(), "content missing").alias("_error"))


def _decoded(entries: DataFrame) -> DataFrame:
    return with_error(entries.withColumn("text", strict_utf8(F.col("content"))).drop("content"), "not UTF-8")


def path_condition(path: Column, skip_dirs: list[str], skip_extensions: list[str]) -> Column:
    """False below a skipped directory or for a skipped extension (given with its dot)."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    name = paths.file_name(path)
    keep = F.lit(True)
    if skip_dirs:
        keep = keep & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in skip_dirs]))
    if skip_extensions:
        keep = keep & ~F.concat(F.lit("."), paths.splitext(name)).isin(*[e.lower() for e in skip_extensions])
    return keep


def from_repo(files: DataFrame, skip_dirs: list[str] = (), skip_extensions: list[str] = (),
              path: str = "file_path") -> DataFrame:
    """Repository files outside the skipped directories and extensions; decide before touching content."""
    return files.filter(path_condition(F.col(path), list(skip_dirs), list(skip_extensions)))


def repo_tree_results(tree: DataFrame, blobs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every blob of a repository tree with its text, or with `_error`: no content, or not UTF-8."""
    return _decoded(with_content(_with_names(tree.filter(F.col("type") == "blob").select(
        F.col("path").alias("file_path"), F.col("name").alias("file_name"),
        paths.modified_at(F.col("committed_date"), "iso").alias("last_modified"))), blobs, buckets))


def from_repo_tree(tree: DataFrame, blobs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The good rows of `repo_tree_results`."""
    return good(repo_tree_results(tree, blobs, buckets))


def drive_results(entries: DataFrame, blobs: DataFrame, readers: Readers | None = None, buckets: int | None = None) -> DataFrame:
    """Every file of a recursive drive listing, all of its pages, with its text or with `_error`."""
    files = with_content(_with_names(entries.filter(F.col("tag") == "file").select(
        F.col("path_display").alias("file_path"), F.col("name").alias("file_name"),
        paths.modified_at(F.col("client_modified"), "iso").alias("last_modified"))), blobs, buckets)
    arrived, missing = quarantine(files)
    return decode_results(arrived, readers).unionByName(missing.drop("content").withColumn("text", F.lit(None).cast("string")))


def from_drive_listing(entries: DataFrame, blobs: DataFrame, readers: Readers | None = None, buckets: int | None = None) -> DataFrame:
    """The good rows of `drive_results`."""
    return good(drive_results(entries, blobs, readers, buckets))


def graph_results(items: DataFrame, blobs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every item with a file facet and a download link of a flat drive listing, with its text or with `_error`."""
    return _decoded(with_content(_with_names(
        items.filter(F.col("file").isNotNull() & (F.coalesce("download_url", F.lit("")) != ""))
        .select(F.col("name").alias("file_path"), F.col("name").alias("file_name"),
                paths.modified_at(F.col("lastModifiedDateTime"), "iso").alias("last_modified"))), blobs, buckets))


def from_graph_items(items: DataFrame, blobs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The good rows of `graph_results`."""
    return good(graph_results(items, blobs, buckets))
