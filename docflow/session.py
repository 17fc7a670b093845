"""Session defaults and the shared folder that durable intermediate results go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: What file systems are called outside of Spark, where it has another name for them.
STORES = {"s3a": "s3", "s3n": "s3"}

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scans of many named files, as those of a stream's batches, list them in this many tasks and not in one per file.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, shuffled_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Start shuffles with enough partitions that each fits in memory; adaptive execution merges small ones."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shuffled_bytes // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return partitions


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster an
    executor could not read back what another one wrote there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="docflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def task_files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, for tasks that read or write files themselves."""
    path = re.sub("^file:/+", "/", path)
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}{mark}{rest}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by `work_path` and all below it, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: durable, and with a size that joins are planned by."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, for work that costs far more than moving them.

    A scan that already has a split per core is left as it is, so this shuffles
    nothing but inputs that are small for the cluster. Give it a scan without
    joins or aggregates: it plans the frame to count its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
