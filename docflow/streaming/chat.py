"""Chat turns that arrive as files, stored once each."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docflow.operators import store
from docflow.operators.chat import PART_TURNS, session_history
from docflow.operators.collections import read_stored
from docflow.operators.ordered import part_of

BUCKETS = 64  # folders that new turns of a table go to; more of them spare more reading once the table is big
KEY = ["session_id", "turn"]


def _bucket(buckets) -> Column:
    return F.pmod(F.xxhash64("session_id"), buckets).cast("int")


def _touched(batch: DataFrame, table: str) -> DataFrame | None:
    """Stored turns in the folders that a batch's sessions have, by every number of buckets the table has been written with.

    The number is part of a folder's name, so it may grow with the table; other folders are not read.
    """
    stored = read_stored(batch.sparkSession, table)
    if stored is None:
        return None
    numbers = [r["buckets"] for r in stored.select("buckets").distinct().collect()]  # read from folder names
    sessions = batch.select("session_id").distinct()
    found = sessions.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _bucket(F.lit(n)).alias("b")) for n in numbers])).alias("f"))
    folders: dict[int, list[int]] = {}
    for row in found.select("f.*").distinct().collect():  # as many as the table has folders at most
        folders.setdefault(row.n, []).append(row.b)
    return stored.filter(reduce(or_, [(F.col("buckets") == n) & F.col("bucket").isin(b) for n, b in folders.items()], F.lit(False)))


def store_turns(turns: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Append the turns the table lacks; repeating a batch, also with another number of buckets, adds nothing."""
    batch = turns.dropDuplicates(KEY)
    stored = _touched(batch, table)
    if stored is not None:
        batch = batch.join(stored.select(*KEY), KEY, "left_anti")
    batch = batch.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.lit(buckets))})
    batch.hint("rebalance", "bucket").write.mode("append").partitionBy("buckets", "bucket").parquet(table)


def stream_chat_append(turns: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS,
                       trigger: dict | None = None) -> StreamingQuery:
    """Store a stream of turns. A batch run again after a failure finds its turns stored already.

    The table itself is the memory of what was seen, so no state grows in the
    executors. `trigger` goes to the stream, `{"availableNow": True}` if not
    given; the source's `maxFilesPerTrigger` bounds a batch.
    """
    return (turns.writeStream.foreachBatch(lambda batch, _: store_turns(batch, table, buckets))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def stored_turns(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("buckets", "bucket")


def stream_session_upsert(turns: DataFrame, table: str, histories: str, checkpoint: str, buckets: int = BUCKETS,
                          trigger: dict | None = None, compact_every: int = 20) -> StreamingQuery:
    """Store turns and rewrite the history parts a batch touches.

    Histories are kept in a store: a batch adds its parts in one step, later
    ones count, and every so many batches buckets in many parts are rewritten
    with the last ones alone. A batch run again adds the same parts once more.
    """
    def upsert(batch: DataFrame, number: int) -> None:
        store_turns(batch, table, buckets)
        part = part_of(F.col("turn"), PART_TURNS)
        changed = batch.select("session_id", part.alias("part")).distinct()
        stored = _touched(changed, table)
        if stored is None:
            return
        turns_of = (stored.withColumn("part", part)
                    .join(changed, ["session_id", "part"], "left_semi").drop("buckets", "bucket", "part"))
        add_histories(session_history(turns_of), histories, buckets)
        if number % compact_every == compact_every - 1:
            compact_histories(batch.sparkSession, histories)

    return (turns.writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def add_histories(parts: DataFrame, histories: str, buckets: int = store.BUCKETS) -> None:
    """Add parts (session_id, part, history) to a store of histories; they count instead of earlier ones."""
    spark = parts.sparkSession
    held = store.manifest(spark, histories)
    version, buckets = (held.version + 1, held.buckets) if held else (1, buckets)
    rows = parts.withColumns({"bucket": store.bucket_of("session_id", buckets), "version": F.lit(version).cast("long")})
    written = store.write_part(rows.hint("rebalance", "bucket"), histories, "histories", version)
    if written:
        replaced = spark.read.parquet(f"{histories}/{written.path}").count() if held else 0  # at most: they may be new
        store.commit(spark, histories, held, {"histories": written}, stale=(held.stale if held else 0) + replaced, buckets=buckets)


def _last_parts(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("session_id", "part")]
    return rows.groupBy("session_id", "part").agg(F.max_by(F.struct(*rest), "version").alias("_last")).select("session_id", "part", "_last.*")


def compact_histories(spark: SparkSession, histories: str, many: int = store.MANY_PARTS, keep: int = 2) -> None:
    """Rewrite buckets in more than `many` parts with the last version of each history part; delete what is no longer read."""
    store.compact(spark, histories, lambda tables: {"histories": _last_parts(tables["histories"])}, many, keep)


def latest_histories(spark: SparkSession, histories: str) -> DataFrame:
    """The last version of each part; nothing is grouped if there is only one."""
    held = store.manifest(spark, histories)
    rows = store.read_table(spark, histories, held, "histories")
    if rows is None:
        return spark.createDataFrame([], "session_id string, part bigint, history array<string>")
    return (_last_parts(rows) if held.stale else rows).select("session_id", "part", "history")
