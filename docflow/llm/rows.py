"""Identity of rows, order of documents and connected rows, for tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from docflow.session import durable, work_path

#: Rows from which a key is put in salts; at least one in `HOT_SHARE` of all, which bounds the list of such keys.
HOT_ROWS, HOT_SHARE = 5_000, 100_000
#: A key that no task has so often is not counted as hot.
HOT_IN_TASK = 16
#: Salts of a hot key, or one in so many rows of the table if that is more.
SALTS, SALT_ROWS = 64, 10_000_000


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add `_r1`, `_r2`, 128 bits of the row's id and text: rows that agree in both are one document."""
    return docs.withColumns({"_r1": F.xxhash64(id_col, text_col), "_r2": F.xxhash64(text_col, F.lit(7), id_col)})


def with_row(rows: DataFrame, fields: str) -> StructType:
    """Schema of the caller's columns in `_row`, whatever they are called, and further fields."""
    return StructType([rows.schema["_row"], *StructType.fromDDL(fields)])


def merged(df: DataFrame) -> DataFrame:
    """`df` in two partitions per core at most, so that small frames are not kept in many tiny files."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def held(df: DataFrame) -> DataFrame:
    """`df` made durable in few files."""
    return durable(merged(df))


def tabled(df: DataFrame, label: str, few: bool = True) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for frames that are read several times; in few files unless it is large."""
    path = work_path(df.sparkSession, label)
    (merged(df) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_salts(rows: DataFrame, key: str, by: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Rows of a table with `_hot`, true for frequent keys, and `_salt`: 0, or a hash of `by` for these; and if there are any.

    A task reports the keys (of 64 bits) that it has `HOT_IN_TASK` times; those
    with `hot_rows`, or one in `HOT_SHARE` of all if that is more, are frequent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0)) for b in batches)]), return_counts=True)
        often = counts >= HOT_IN_TASK
        yield pa.record_batch([pa.array(keys[often]), pa.array(counts[often])], names=[key, "n"])

    total = rows.count()
    counted = rows.select(key).mapInArrow(run, f"{key} long, n long").groupBy(key).agg(F.sum("n").alias("n"))
    hot = tabled(counted.filter(F.col("n") >= max(hot_rows, total // HOT_SHARE)).select(key, F.lit(True).alias("_hot")), "hot-keys")
    # An outer join, so that each row comes once whatever is hot.
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    salt = F.pmod(F.xxhash64(*by), F.lit(max(SALTS, total // SALT_ROWS)))
    return marked.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)), not hot.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every node of the links (a, b): the root is the smallest node connected with it.

    Large-star and small-star steps in turn, each a join with a minimum per
    node, until the links are stars; the number of rounds grows with the
    logarithm of the longest path. Every round is made durable.
    """
    links = held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a is not null and b is not null and a <> b").distinct())
    seen = None
    while True:
        both = links.union(links.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = held(small.union(smallest.toDF("a", "b")).filter("a <> b").distinct())
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct().toDF("node", "root"))
        seen = now
