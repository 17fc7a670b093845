"""Embedding steps: the built-in hash embedding, or any model behind an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docflow.functions.vectors import hash_embedding


def embed_hashed(df: DataFrame, text: str = "text", dim: int = 64, into: str = "embedding") -> DataFrame:
    return df.withColumn(into, hash_embedding(F.col(text), dim))


def embed(df: DataFrame, load_model: Callable[[], Callable], text: str = "text", batch: int = 8,
          into: str = "embedding") -> DataFrame:
    """Embed with a model: `load_model()` runs once per task and returns a function from texts to vectors."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in series:
            vectors = []
            for start in range(0, len(texts), batch):
                vectors.extend(list(map(float, v)) for v in model(list(texts.iloc[start:start + batch])))
            yield pd.Series(vectors, dtype="object")

    return df.withColumn(into, encode(F.col(text)))
