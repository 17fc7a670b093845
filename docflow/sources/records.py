"""Landed issues, posts and key-value entries as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docflow.functions import paths
from docflow.functions.records import KV_KINDS, issue_text, post_text, post_type, render_kv, ttl_label


def from_issues(issues: DataFrame, source_id: str) -> DataFrame:
    """Issue documents; the type is lowercased as metadata, not in the text.

    Takes nested exports: `key` and `fields` with issuetype, status, assignee and reporter structs.
    """
    f = {
        "issue_key": F.col("key"), "summary": F.col("fields.summary"), "description": F.col("fields.description"),
        "issue_type": F.col("fields.issuetype.name"), "status": F.col("fields.status.name"),
        "created": F.col("fields.created"), "updated": F.col("fields.updated"),
    }
    return issues.select(
        issue_text(f).alias("text"), f["issue_key"].alias("issue_key"), f["summary"].alias("summary"),
        F.lower(f["issue_type"]).alias("issue_type"), f["status"].alias("status"),
        f["created"].alias("created"), f["updated"].alias("updated"),
        F.col("fields.assignee.displayName").alias("assignee"),
        F.col("fields.reporter.displayName").alias("reporter"), F.lit(source_id).alias("data_source_id"))


def newest_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first `n` rows per key. Spark prunes to `n` per task before it shuffles."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def from_posts(posts: DataFrame, source_id: str, n: int = 200) -> DataFrame:
    """The newest `n` posts of each user, reposts rewritten with their author."""
    newest = newest_per(posts, "user", [F.desc("created_at"), F.desc("post_id")], n)
    return newest.select(
        post_text(F.col("text"), F.col("original.user"), F.col("original.text")).alias("text"),
        "post_id", "created_at", "user", "retweet_count", "favorite_count",
        post_type(F.col("original.user")).alias("content_type"), F.lit(source_id).alias("data_source_id"))


def from_kv(entries: DataFrame, source_id: str) -> DataFrame:
    """One document per entry of a supported kind."""
    name = paths.file_name(F.col("key"))
    return entries.filter(F.col("kind").isin(*KV_KINDS)).select(
        render_kv(F.col("kind"), F.col("s"), F.col("h"), F.col("l"), F.col("z")).alias("text"),
        F.col("key").alias("file_path"), name.alias("file_name"), F.lit("").alias("file_extension"),
        paths.file_type(name).alias("file_type"), ttl_label(F.col("ttl_s")).alias("expiry"),
        F.lit(source_id).alias("data_source_id"))
