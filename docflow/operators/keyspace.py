"""Operators on typed key-value entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.operators.ordered import rank_rows


def keyspace_summary(entries: DataFrame, separator: str = ":") -> DataFrame:
    """Entries per key prefix and kind."""
    prefix = F.substring_index("key", separator, 1).alias("prefix")
    return entries.groupBy(prefix, "kind").agg(F.count("*").alias("n_keys"))


def zset_order(members: DataFrame) -> DataFrame:
    """Sorted-set reading order of (key, member, score) rows: ascending score, then member."""
    return rank_rows(members, ["key"], ["score", "member"], "place")


def set_members(members: DataFrame) -> DataFrame:
    """Distinct (key, member) rows; repeats vanish before the shuffle."""
    return members.select("key", "member").distinct()
