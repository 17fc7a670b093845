"""Tables behind a database connection, and persisted JSON indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docflow.schema import STRING_MAP


def read_table(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A database table. Give `partitionColumn`, bounds and `numPartitions` to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


def _json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def load_index_json(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of an index persisted as `docstore.json` and `default__vector_store.json`."""
    record = T.StructType([T.StructField("__data__", T.StructType([
        T.StructField("text", T.StringType()), T.StructField("start_char_idx", T.IntegerType()),
        T.StructField("end_char_idx", T.IntegerType()), T.StructField("metadata", STRING_MAP)]))])
    lineage = T.StructType([T.StructField("doc_hash", T.StringType()), T.StructField("ref_doc_id", T.StringType())])
    stores = _json_files(spark, f"{root}/docstore.json", T.StructType([
        T.StructField("docstore/data", T.MapType(T.StringType(), record)),
        T.StructField("docstore/metadata", T.MapType(T.StringType(), lineage))]))
    vectors = _json_files(spark, f"{root}/default__vector_store.json", T.StructType([
        T.StructField("embedding_dict", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))]))
    texts = stores.select(F.explode("`docstore/data`").alias("node_id", "n")).select(
        "node_id", F.col("n.__data__.text").alias("text"), F.col("n.__data__.start_char_idx").alias("start_char"),
        F.col("n.__data__.end_char_idx").alias("end_char"), F.col("n.__data__.metadata").alias("metadata"))
    owners = stores.select(F.explode("`docstore/metadata`").alias("node_id", "m")).select(
        "node_id", F.col("m.ref_doc_id").alias("ref_doc_id"), F.col("m.doc_hash").alias("doc_hash"))
    embedded = vectors.select(F.explode("embedding_dict").alias("node_id", "embedding"))
    return texts.join(owners, "node_id", "left").join(embedded, "node_id", "left")
