"""Text renderings of issues, posts, key-value entries and nodes."""

from pyspark.sql import Column, functions as F

# The entry kinds that have a text form.
KV_KINDS = ["string", "hash", "list", "set", "zset"]

# Label and field of each line of an issue's text.
ISSUE_LINES = [
    ("Issue Key", "issue_key"), ("Summary", "summary"), ("Description", "description"),
    ("Issue Type", "issue_type"), ("Status", "status"), ("Created", "created"), ("Updated", "updated"),
]

# Metadata a node shows neither to the embedding nor to the prompt.
HIDDEN_NODE_KEYS = ["file_name", "file_type", "file_size", "creation_date", "last_modified_date", "last_accessed_date"]


def issue_text(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(fields[name].cast("string"), F.lit("None")))
             for label, name in ISSUE_LINES]
    return F.trim(F.concat_ws("\n", *lines))


def post_text(text: Column, original_user: Column, original_text: Column) -> Column:
    return F.when(original_user.isNotNull(),
                  F.concat(F.lit("RT @"), original_user, F.lit(": "), original_text)).otherwise(text)


def post_type(original_user: Column) -> Column:
    return F.when(original_user.isNotNull(), "retweet").otherwise("tweet")


def ttl_label(ttl: Column) -> Column:
    return F.when(ttl > 0, ttl.cast("string")).otherwise("no_expiry")


def zset_members(entries: Column) -> Column:
    """Members by ascending score, equal scores by member."""
    by_score = F.array_sort(F.transform(
        entries, lambda e: F.struct(e["score"].alias("score"), e["member"].alias("member"))))
    return F.transform(by_score, lambda e: e["member"])


def render_kv(kind: Column, s: Column, h: Column, l: Column, z: Column) -> Column:
    """Text of one entry: the string itself, or canonical JSON of the other kinds."""
    sorted_hash = F.map_from_entries(F.array_sort(F.map_entries(h)))
    return (F.when(kind == "string", s)
            .when(kind == "hash", F.to_json(sorted_hash))
            .when(kind == "list", F.to_json(l))
            .when(kind == "set", F.to_json(F.array_sort(F.array_distinct(l))))
            .when(kind == "zset", F.to_json(zset_members(z))))


def render_node(entries: Column, text: Column, excluded=tuple(HIDDEN_NODE_KEYS)) -> Column:
    """`key: value` lines of the metadata entries not excluded, a blank line, the text.

    `entries` is an array of (key, value) structs, because its order is the order of the lines.
    """
    kept = F.filter(entries, lambda e: ~e["key"].isin(*excluded)) if excluded else entries
    lines = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat(lines, F.lit("\n\n"), text)
