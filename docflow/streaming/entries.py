"""Key-value entries that arrive as a stream: the last write of a key counts, until its time to live has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docflow.operators import store
from docflow.operators.quality import unexpired

ORDER = ("written_at",)


def _last(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The last write of each key, and of equal ones that stored last. Counted down before the shuffle, so a key may be hot."""
    rest = [c for c in rows.columns if c not in ("bucket", "key")]
    by = F.struct(*order, *[c for c in ("version",) if c in rows.columns])
    return rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), by).alias("_e")).select("bucket", "key", "_e.*")


def _add(rows: DataFrame, root: str, held: store.Manifest | None, buckets: int = store.BUCKETS) -> None:
    spark, version = rows.sparkSession, held.version + 1 if held else 1
    part = store.write_part(rows.withColumn("version", F.lit(version).cast("long")).hint("rebalance", "bucket"), root, "entries", version)
    if part:
        replaced = spark.read.parquet(f"{root}/{part.path}").count() if held else 0
        store.commit(spark, root, held, {"entries": part}, stale=(held.stale if held else 0) + replaced, buckets=buckets)


def put_entries(entries: DataFrame, root: str, order: tuple[str, ...] = ORDER, buckets: int = store.BUCKETS) -> None:
    """Store the last write of each key of a batch (`key`, `written_at`, `ttl_s` and others); null keys are left out.

    Writes may come late: what is stored already stays if it is later by `order`.
    """
    held = store.manifest(entries.sparkSession, root)
    buckets = held.buckets if held else buckets
    given = entries.filter("key is not null").withColumns({"bucket": store.bucket_of("key", buckets), "removed": F.lit(False)})
    _add(_last(given, order), root, held, buckets)


def stream_entries(entries: DataFrame, root: str, checkpoint: str, order: tuple[str, ...] = ORDER, compact_every: int = 20,
                   trigger: dict | None = None, buckets: int = store.BUCKETS) -> StreamingQuery:
    """Store a stream of writes. A batch run again after a failure stores its writes once more, which changes nothing."""
    def put(batch: DataFrame, number: int) -> None:
        put_entries(batch, root, order, buckets)
        if number % compact_every == compact_every - 1:
            compact_entries(batch.sparkSession, root, order)

    return (entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _stored(spark: SparkSession, root: str, order: tuple[str, ...]) -> tuple[store.Manifest | None, DataFrame | None]:
    held = store.manifest(spark, root)
    rows = store.read_table(spark, root, held, "entries")
    return held, None if rows is None else _last(rows, order).filter("not removed")


def live_entries(spark: SparkSession, root: str, as_of, order: tuple[str, ...] = ORDER) -> DataFrame | None:
    """The last write of each key that has not expired at `as_of`; None if nothing is stored."""
    _, rows = _stored(spark, root, order)
    return None if rows is None else unexpired(rows, as_of).drop("bucket", "version", "removed")


def expire_entries(spark: SparkSession, root: str, as_of, order: tuple[str, ...] = ORDER) -> DataFrame | None:
    """Remove the keys that have expired at `as_of`, and return them with their last writes: each key once for that write.

    A later write brings its key back; one that comes late and is older does not.
    """
    held, rows = _stored(spark, root, order)
    if rows is None:
        return None
    gone = rows.join(unexpired(rows, as_of).select("bucket", "key"), ["bucket", "key"], "left_anti").withColumn("removed", F.lit(True))
    number = held.version + 1
    _add(gone.drop("version"), root, held)
    now = store.manifest(spark, root)
    if now.version != number:  # nothing has expired
        return gone.limit(0).drop("bucket", "version", "removed")
    return spark.read.parquet(f"{root}/{now.parts['entries'][-1].path}").drop("bucket", "version", "removed")


def compact_entries(spark: SparkSession, root: str, order: tuple[str, ...] = ORDER, many: int = store.MANY_PARTS, keep: int = 2) -> None:
    """Rewrite buckets in more than `many` parts with the last write of each key. Removals stay, so that writes that come
    late do not bring a key back."""
    store.compact(spark, root, lambda tables: {"entries": _last(tables["entries"], order)}, many, keep)
