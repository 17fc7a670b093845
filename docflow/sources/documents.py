"""The one document shape all sources end in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.schema import DOCUMENT


def as_documents(df: DataFrame, source_id: str, key: list[str]) -> DataFrame:
    """Rows of any source in the DOCUMENT shape.

    `key` names the columns that identify an item in its source. Columns the
    shape does not have become metadata entries; null ones give no entry.
    """
    names = {f.name for f in DOCUMENT.fields}
    extra = [c for c in df.columns if c not in names]
    given = {c: F.col(c) for c in df.columns if c in names}
    given["data_source_id"] = F.lit(source_id)
    given.setdefault("doc_id", F.sha2(F.concat_ws("#", F.lit(source_id), *key), 256))
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in extra])
    own = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if extra else None
    if own is not None:
        given["metadata"] = F.map_concat(given["metadata"], own) if "metadata" in given else own
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


@dataclass(frozen=True)
class ReaderSource:
    """Any reader as a source of an ingest job.

    `read` gives the reader's rows, `key` the columns that identify one.
    `enrich` gets the documents, for instance to change their metadata.
    """

    read: Callable[[SparkSession], DataFrame]
    source_id: str
    key: tuple[str, ...]
    rule_key: str = "text"
    enrich: Callable[[DataFrame], DataFrame] = lambda docs: docs

    def documents(self, spark: SparkSession) -> DataFrame:
        return self.enrich(as_documents(self.read(spark), self.source_id, list(self.key)))
