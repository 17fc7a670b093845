"""Joins and key checks that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `rows` rows and in how many pieces of so many rows to cut them (`_cuts`).

    There are at most as many as the table has rows divided by `rows`. Counts before it shuffles.
    """
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counted.filter(F.col("_n") > rows).select(key, F.ceil(F.col("_n") / rows).alias("_cuts"))


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS,
              hot: DataFrame | None = None) -> DataFrame:
    """Join rows to the single row their key names, with every key of more than `hot_rows` rows cut into pieces.

    Rows go to a piece by their place in the input, so equal rows spread too.
    Only the hot keys' rows of `one` are repeated, once per piece. The list of
    hot keys is sent to both sides; its length is bounded as `hot_keys` says.
    Smaller keys are left to the adaptive skew join. `hot` is that list (`key`,
    `_cuts`), if the caller knows it without another pass over `many`.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    hot = F.broadcast(hot_keys(many, key, hot_rows) if hot is None else hot)
    cuts = F.coalesce("_cuts", F.lit(1))
    left = many.withColumn("_at", F.monotonically_increasing_id()).join(hot, key, "left").withColumn(
        "_salt", F.pmod("_at", cuts)).drop("_at", "_cuts")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1))).drop("_cuts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def missing_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their row counts; rows are counted before the shuffle."""
    counted = child.filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n_rows"))
    return counted.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
