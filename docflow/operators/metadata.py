"""Metadata columns, previews and result shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.functions import paths
from docflow.session import durable


def with_source(df: DataFrame, source_id: str, method: str | None = None, name: str = "file_name") -> DataFrame:
    added = {"data_source_id": F.lit(source_id), "file_type": paths.file_type(F.coalesce(F.col(name), F.lit("")))}
    if method is not None:
        added["processing_method"] = F.lit(method)
    return df.withColumns(added)


def with_path_parts(df: DataFrame, path: str = "file_path") -> DataFrame:
    return (df.withColumn("file_name", paths.file_name(F.col(path)))
            .withColumns({
                "file_extension": paths.file_extension(F.col("file_name")),
                "file_stem_extension": paths.splitext(F.col("file_name")),
                "file_type": paths.file_type(F.col("file_name")),
            }))


def prune_metadata(df: DataFrame, keys: list[str], metadata: str = "metadata") -> DataFrame:
    return df.withColumn(metadata, F.map_filter(metadata, lambda key, _: key.isin(*keys)))


def lower_key(df: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    return df.withColumn(metadata, F.transform_values(
        metadata, lambda k, v: F.when(k == key, F.lower(v)).otherwise(v)))


def default_key(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(value)))


def preview(df: DataFrame, order: str, n: int = 10, chars: int = 50, text: str = "text") -> DataFrame:
    """The first `n` rows in order with the start of their text."""
    return df.select(order, F.substring(text, 1, chars).alias("preview")).orderBy(order).limit(n)


def positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"Col{i}" for i in range(len(df.columns))])


def shape_result(df: DataFrame, empty: str = "No results found") -> DataFrame:
    """A `result` column: a message for no rows, the bare value for one cell, else JSON per row. The query runs once."""
    df = durable(df)
    head = df.limit(2).count()
    if head == 0:
        return df.sparkSession.range(1).select(F.lit(empty).alias("result"))
    if head == 1 and len(df.columns) == 1:
        return df.select(F.col(df.columns[0]).cast("string").alias("result"))
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("result"))
