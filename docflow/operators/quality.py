"""Error isolation, expiry and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docflow.functions.text import has_text
from docflow.session import saved


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(has_text(F.col(text)))


def parse_json(df: DataFrame, column: str, schema: T.StructType, into: str = "parsed") -> DataFrame:
    """Add the parsed record and `_error`, which is null for a good one."""
    guarded = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(column), guarded, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    error = F.when(F.col(column).isNull(), "missing").when(F.col(f"{into}._corrupt").isNotNull(), "malformed")
    return df.withColumn(into, parsed).withColumn("_error", error).withColumn(into, F.col(into).dropFields("_corrupt"))


def good(df: DataFrame) -> DataFrame:
    """The rows without an `_error`."""
    return df.filter(F.col("_error").isNull()).drop("_error")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an `_error`. They are written once, so using both does not run their source twice."""
    held = saved(df, "quarantine")
    return good(held), held.filter(F.col("_error").isNotNull())


def unexpired(df: DataFrame, as_of, written_at: str = "written_at", ttl: str = "ttl_s") -> DataFrame:
    """Entries without a time to live, or whose time has not passed at `as_of`."""
    expires = F.timestamp_add("SECOND", F.col(ttl), F.col(written_at))
    return df.filter(F.col(ttl).isNull() | (expires > F.lit(as_of)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null key values held by more than one row."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def constraint_report(checks: list[tuple]) -> DataFrame:
    """One row (check_name, violations) per check.

    A check is (name, "unique", df, keys), (name, "not_null", df, column) or
    (name, "reference", child, child_key, parent, parent_key). Violations are
    key values that several rows have, nulls, and child rows without a parent.

    Each table is scanned once: a row gives an entry for each check it takes
    part in, and entries are counted by check and key before they are shuffled.
    """
    tables: list[tuple[DataFrame, list[Column]]] = []

    def enter(df: DataFrame, no: int, keys: list[str], when: Column, rows: int, parent: bool) -> None:
        entry = F.when(when, F.struct(F.lit(no).alias("no"), F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>").alias("key"),
                                      F.lit(rows).alias("rows"), F.lit(parent).alias("parent")))
        for known, entries in tables:
            if known is df or known.sameSemantics(df):
                entries.append(entry)
                return
        tables.append((df, [entry]))

    def present(keys: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    amounts = F.lit(0)
    for no, (_, kind, df, *rest) in enumerate(checks):
        if kind == "unique":
            enter(df, no, list(rest[0]), present(rest[0]), 1, False)
            amount = (F.col("n") > 1).cast("bigint")
        elif kind == "not_null":
            enter(df, no, [], F.col(rest[0]).isNull(), 1, False)
            amount = F.col("n")
        elif kind == "reference":
            child_key, parent, parent_key = rest
            enter(df, no, [child_key], present([child_key]), 1, False)
            enter(parent, no, [parent_key], present([parent_key]), 0, True)
            amount = F.when(F.col("parent"), 0).otherwise(F.col("n"))
        else:
            raise ValueError(f"unknown check: {kind}")
        amounts = F.when(F.col("no") == no, amount).otherwise(amounts)
    entered = reduce(DataFrame.unionAll, [df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))) for df, entries in tables])
    counted = entered.groupBy("no", "key").agg(F.sum("rows").alias("n"), F.bool_or("parent").alias("parent"))
    found = counted.groupBy("no").agg(F.sum(amounts).alias("violations"))
    named = checks[0][2].sparkSession.createDataFrame([(i, c[0]) for i, c in enumerate(checks)], "no int, check_name string")
    return named.join(found, "no", "left").select("check_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
