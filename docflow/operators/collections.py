"""Named collections of nodes on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docflow.operators import store
from docflow.operators.ordered import part_of
from docflow.schema import NODE
from docflow.session import path_exists, saved

#: Replaced document versions that are sent to all tasks to leave their nodes out; more are joined by a shuffle.
SENT_STALE = 1_000_000


class CollectionError(ValueError):
    pass


def union_sources(*frames: DataFrame) -> DataFrame:
    """Documents of unlike sources in one frame; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_stored(spark: SparkSession, root: str) -> DataFrame | None:
    """The table at `root`, or None when nothing has been written there yet."""
    if not path_exists(spark, root):
        return None
    try:
        return spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def write_collection(nodes: DataFrame, root: str, name: str, unique: bool = False,
                     embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add nodes to a collection; a node id it already holds is left alone, so a rerun adds nothing.

    `embed` is applied to what is left, so vectors are only computed for nodes
    that are written.

    With `unique` the caller vouches that no id comes twice in `nodes`, which
    spares a first load its only shuffle.
    """
    fresh = nodes if unique else nodes.dropDuplicates(["node_id"])
    stored = read_stored(nodes.sparkSession, root)
    if stored is not None:
        held = stored.filter(F.col("collection") == name).select("node_id")
        fresh = fresh.join(held, "node_id", "left_anti")
    if embed is not None:
        fresh = embed(fresh)
    fresh.withColumn("collection", F.lit(name)).write.mode("append").partitionBy("collection").parquet(root)


def store_root(root: str, name: str) -> str:
    """Where a collection lies that is kept by `update_collection` or `sync_listing`."""
    return f"{root.rstrip('/')}.collections/{name}"


def current_documents(spark: SparkSession, root: str, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
    """`doc_id`, `doc_hash`, `scope`, `version`, `bucket` of a collection's documents as they are now; those of some buckets
    from these buckets' folders alone. None if it is not kept by documents, or has none there."""
    place = store_root(root, name)
    return _current(store.read_table(spark, place, store.manifest(spark, place), "documents", buckets))


def _current(recorded: DataFrame | None) -> DataFrame | None:
    if recorded is None:
        return None
    last = recorded.groupBy("bucket", "doc_id").agg(F.max_by(F.struct("doc_hash", "scope", "version", "removed"), "version").alias("d"))
    return last.filter("not d.removed").select("doc_id", "d.doc_hash", "d.scope", "d.version", "bucket")


def _visible(nodes: DataFrame, recorded: DataFrame, stale: int) -> DataFrame:
    """Nodes of the documents as they are now. Only what later runs replaced or removed is joined, so nothing is if there
    is no such thing; `stale` bounds it."""
    if not stale:
        return nodes
    held = recorded.select("doc_id", "version", "bucket", F.max("version").over(W.partitionBy("bucket", "doc_id")).alias("_last"))
    gone = held.filter("version < _last").select(F.col("doc_id").alias("ref_doc_id"), "version").distinct()
    return nodes.join(F.broadcast(gone) if stale <= SENT_STALE else gone, ["ref_doc_id", "version"], "left_anti")


def sync_listing(listing: DataFrame, load: Callable[[DataFrame | None], DataFrame], nodes_of: Callable[[DataFrame], DataFrame], root: str,
                 name: str, *, scope: str = "", complete: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None,
                 buckets: int = store.BUCKETS) -> dict[str, int]:
    """Bring a collection up to date with a listing of documents; returns how many were added, changed and removed.

    `listing` has a `doc_id` and a `doc_hash` that changes whenever the document
    does; a null id is left out, and of an id that comes twice the smallest
    hash counts. Only for new and changed documents, `load` gets their rows of
    the listing and returns documents (None stands for all rows, if none is to
    be left out), and `nodes_of` turns these into nodes with a `ref_doc_id`;
    `embed` sees no others either.

    A `complete` listing names all documents of its `scope`, so what is
    recorded for the scope and not listed is removed. Otherwise the listing is
    a batch, and only the recorded documents in its buckets are read: the cost
    follows the batch. Nodes, versions and removals count from one manifest on;
    a run that broke off can be repeated, and one that finds nothing to do
    writes nothing. `buckets` is how many a new collection gets.
    """
    spark, place = listing.sparkSession, store_root(root, name)
    held = store.manifest(spark, place)
    buckets = held.buckets if held else buckets
    given = listing.withColumn("doc_id", F.col("doc_id").cast("string"))
    rest = [c for c in given.columns if c != "doc_id"]
    given = given.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "doc_hash").alias("_d"), F.count("*").alias("_n")).select("doc_id", "_d.*", "_n")
    given = saved(given.withColumn("bucket", store.bucket_of("doc_id", buckets)), "listing")
    listed, odd = given.agg(F.count("*"), F.count_if((F.col("_n") > 1) | F.col("doc_id").isNull())).first()
    given = given.filter("doc_id is not null").drop("_n")
    touched = None if complete else [r.bucket for r in given.select("bucket").distinct().collect()]
    known = _current(store.read_table(spark, place, held, "documents", touched))
    if known is None:
        marked = given.withColumn("_kind", F.lit("added"))
    else:
        before = known.select("doc_id", "bucket", F.struct("doc_hash", "scope").alias("_known"))
        both = given.withColumn("_new", F.lit(True)).join(before, ["doc_id", "bucket"], "full_outer")
        same_scope = F.col("_known.scope") == scope
        kind = (F.when(F.col("_new").isNull(), F.when(F.lit(complete) & same_scope, "removed"))
                .when(F.col("_known").isNull(), "added").when((F.col("_known.doc_hash") != F.col("doc_hash")) | ~same_scope, "changed"))
        marked = both.withColumn("_kind", kind).filter("_kind is not null").drop("_known", "_new")
    marked = saved(marked, "changes")
    counts = {"added": 0, "changed": 0, "removed": 0} | {r["_kind"]: r["count"] for r in marked.groupBy("_kind").count().collect()}
    if not sum(counts.values()):
        return counts
    version = held.version + 1 if held else 1
    fresh = None if not odd and counts["added"] + counts["changed"] == listed else marked.filter("_kind <> 'removed'").drop("_kind", "bucket")
    # Documents are moved to their buckets before they are cut: nodes and vectors are larger.
    docs = load(fresh).withColumn("bucket", store.bucket_of(F.col("doc_id").cast("string"), buckets)).hint("rebalance", "bucket")
    nodes = nodes_of(docs.drop("bucket"))
    nodes = (embed(nodes) if embed else nodes).withColumns({"bucket": store.bucket_of("ref_doc_id", buckets), "version": F.lit(version).cast("long")})
    records = marked.select("doc_id", "doc_hash", F.lit(scope).alias("scope"), F.lit(version).cast("long").alias("version"),
                            (F.col("_kind") == "removed").alias("removed"), "bucket")
    stale = (held.stale if held else 0) + counts["changed"] + counts["removed"]
    store.commit(spark, place, held, {"nodes": store.write_part(nodes, place, "nodes", version) if counts["added"] + counts["changed"] else None,
                                      "documents": store.write_part(records, place, "documents", version)}, stale=stale, buckets=buckets)
    return counts


def update_collection(docs: DataFrame, nodes_of: Callable[[DataFrame], DataFrame], root: str, name: str,
                      embed: Callable[[DataFrame], DataFrame] | None = None, text: str = "text", *, scope: str = "",
                      complete: bool = False, buckets: int = store.BUCKETS) -> dict[str, int]:
    """`sync_listing` for documents that carry their text: they are listed by its hash, and read again for what changed."""
    hashed = with_doc_hash(docs, text).withColumn("doc_id", F.col("doc_id").cast("string"))

    def load(changed: DataFrame | None) -> DataFrame:
        return hashed if changed is None else hashed.join(changed, ["doc_id", "doc_hash"], "left_semi").dropDuplicates(["doc_id"])

    return sync_listing(hashed.select("doc_id", "doc_hash"), load, nodes_of, root, name, scope=scope, complete=complete, embed=embed, buckets=buckets)


def compact_collection(spark: SparkSession, root: str, name: str, many: int = store.MANY_PARTS, keep: int = 2) -> None:
    """Rewrite buckets in more than `many` parts, without what later runs replaced or removed; delete parts no longer read."""
    place = store_root(root, name)
    held = store.manifest(spark, place)

    def newest(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        recorded = tables["documents"]
        last = _current(recorded).withColumn("removed", F.lit(False)).select(*recorded.columns)
        return {"documents": last} | ({"nodes": _visible(tables["nodes"], recorded, held.stale)} if "nodes" in tables else {})

    store.compact(spark, place, newest, many, keep)


def open_collection(spark: SparkSession, root: str, name: str, mode: str = "strict", schema=NODE) -> DataFrame:
    """Nodes of one collection.

    `strict` fails when it is missing or empty, which are the same on storage;
    `create` gives a frame without rows then. Of a collection that is kept by
    documents these are the nodes of the documents as they are now.
    """
    if mode not in ("strict", "create"):
        raise ValueError(f"unknown mode: {mode}")
    place = store_root(root, name)
    held = store.manifest(spark, place)
    if held is not None:
        nodes, recorded = (store.read_table(spark, place, held, table) for table in ("nodes", "documents"))
        nodes = _visible(nodes, recorded, held.stale).drop("version", "bucket") if nodes is not None else None
    else:
        stored = read_stored(spark, root)
        nodes = stored.filter(F.col("collection") == name) if stored is not None else None
    if nodes is None:
        if mode == "create":
            return spark.createDataFrame([], schema)
        raise CollectionError(f"collection is missing: {name}")
    if mode == "strict" and nodes.isEmpty():
        raise CollectionError(f"collection is missing or empty: {name}")
    return nodes


def collection_counts(nodes: DataFrame, collection: str = "collection") -> DataFrame:
    return nodes.groupBy(collection).agg(F.count("*").alias("n_nodes"))


def ref_doc_info(nodes: DataFrame, part_nodes: int = 1000) -> DataFrame:
    """Node ids per document in chunk order, in arrays of at most `part_nodes`."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "node_id")))
    return (nodes.withColumn("part", part_of(F.col("chunk_no"), part_nodes)).groupBy("ref_doc_id", "part")
            .agg(F.transform(ordered, lambda n: n["node_id"]).alias("node_ids")))


def persist_index(nodes: DataFrame, root: str) -> None:
    """Nodes and the document-to-nodes table, each as parquet below `root`."""
    nodes.write.mode("overwrite").parquet(f"{root}/nodes")
    ref_doc_info(nodes.sparkSession.read.parquet(f"{root}/nodes")).write.mode("overwrite").parquet(f"{root}/ref_doc_info")


def with_doc_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("doc_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def changed_docs(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents that are new or whose hash differs from the indexed one."""
    return docs.join(indexed.select("doc_id", "doc_hash"), ["doc_id", "doc_hash"], "left_anti")
