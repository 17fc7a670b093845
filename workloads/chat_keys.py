"""Chat history, key-value entries, issues, posts and task logs."""

from functools import reduce

from pyspark.sql import functions as F

from docflow.functions.records import post_text, post_type
from docflow.functions.units import pattern_unit, units_in
from docflow.operators import chat, keyspace
from docflow.operators.collections import open_collection
from docflow.operators.metadata import lower_key
from docflow.plans.ingest import collection_sink, run_ingest
from docflow.plans.tasks import TaskLog, task_status as latest_status
from docflow.session import work_path
from docflow.sources.documents import ReaderSource
from docflow.sources.records import from_issues, from_kv, from_posts, newest_per
from docflow.streaming import chat as chat_stream, entries as entry_stream
from workloads.registry import query


def turns(t):
    return as_turns(t.conversations)


def as_turns(conversations):
    return conversations.select(
        F.concat(F.lit("session_"), "conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("turn"),
        "role", "text")


TURNS_CTE = r"""
WITH turns AS (SELECT 'session_' || conv_id AS session_id, turn, role, text,
                      upper(role[1]) || role[2:] || ': ' || text AS line,
                      len(regexp_extract_all(text, '\S+')) AS tokens FROM conversations)
"""


@query("history_of_session", TURNS_CTE + "SELECT session_id, turn, role, text FROM turns WHERE session_id = 'session_7'")
def history_of_session(t):
    return chat.get_history(turns(t), "session_7")


@query("list_sessions", TURNS_CTE + "SELECT DISTINCT session_id FROM turns")
def list_sessions(t):
    return chat.list_sessions(turns(t))


@query("sessions_by_glob", TURNS_CTE + r"SELECT DISTINCT session_id FROM turns WHERE regexp_matches(session_id, '^session_1.*[02468]$')")
def sessions_by_glob(t):
    return chat.list_sessions(turns(t), "session_1*[02468]")


@query("session_count", "SELECT count(DISTINCT conv_id) AS n_sessions FROM conversations")
def session_count(t):
    return chat.session_count(turns(t))


@query("role_lines", TURNS_CTE + "SELECT session_id, turn, line FROM turns")
def role_lines(t):
    return chat.with_line(turns(t)).select("session_id", "turn", "line")


@query("new_session_keys")
def new_session_keys(t):
    return t.conversations.select("conv_id").distinct().withColumn("session_id", chat.new_session_key())


@query("session_history", TURNS_CTE + """
SELECT session_id, turn // 1000 AS part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY turn) AS history
FROM turns GROUP BY ALL""")
def session_history(t):
    return chat.session_history(turns(t)).select(
        "session_id", "part", F.size("history").cast("bigint").alias("n_lines"),
        F.array_join("history", "\n").alias("history"))


@query("history_snapshots", TURNS_CTE + """
SELECT a.session_id, a.turn, a.line,
       (SELECT count(*) FROM turns b WHERE b.session_id = a.session_id AND b.role = 'assistant' AND b.turn < a.turn) + 1 AS snapshot_no,
       (SELECT count(*) FROM turns b WHERE b.session_id = a.session_id AND b.turn <= a.turn) AS lines_so_far,
       (SELECT sum(length(b.line)) FROM turns b WHERE b.session_id = a.session_id AND b.turn <= a.turn)::bigint AS chars_so_far
FROM turns a
WHERE EXISTS (FROM turns b WHERE b.session_id = a.session_id AND b.role = 'assistant' AND b.turn >= a.turn)""")
def history_snapshots(t):
    return chat.history_snapshots(turns(t))


@query("memory_window", TURNS_CTE + """
SELECT session_id, turn, role, tokens_from_end FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC)::bigint AS tokens_from_end FROM turns)
WHERE tokens_from_end <= 300""")
def memory_window(t):
    return chat.memory_window(turns(t), 300).select("session_id", "turn", "role", "tokens_from_end")


@query("memory_window_user_first", TURNS_CTE + """
, kept AS (SELECT * FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC)::bigint AS tokens_from_end FROM turns)
  WHERE tokens_from_end <= 300)
SELECT session_id, turn, role, tokens_from_end FROM kept k
WHERE turn >= (SELECT min(u.turn) FROM kept u WHERE u.session_id = k.session_id AND u.role = 'user')""")
def memory_window_user_first(t):
    return chat.memory_window(turns(t), 300, start_with_user=True).select(
        "session_id", "turn", "role", "tokens_from_end")


# The same fixed tokenizer as for chunks: four letters or digits at most, or any other character.
@query("memory_window_tokens", """
WITH turns AS (SELECT 'session_' || conv_id AS session_id, turn, role, len(regexp_extract_all(text, '[A-Za-z0-9]{1,4}|\\S')) AS tokens FROM conversations)
SELECT session_id, turn, role, tokens_from_end FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC)::bigint AS tokens_from_end FROM turns)
WHERE tokens_from_end <= 500""")
def memory_window_tokens(t):
    cost = units_in(pattern_unit("[A-Za-z0-9]{1,4}"), F.col("text"))
    return chat.memory_window(turns(t), 500, cost).select("session_id", "turn", "role", "tokens_from_end")


@query("transcript_export", TURNS_CTE + """
SELECT session_id, turn AS line_no, line FROM turns
UNION ALL SELECT DISTINCT session_id, -2, 'CHAT HISTORY (' || session_id || ')' FROM turns
UNION ALL SELECT DISTINCT session_id, -1, repeat('-', 50) FROM turns""")
def transcript_export(t):
    return chat.transcript_lines(turns(t))


# Turns up to 3 are stored; all of them arrive again, each one twice.
@query("append_turns", TURNS_CTE + "SELECT session_id, turn, role, text FROM turns")
def append_turns(t):
    stored = turns(t).filter(F.col("turn") <= 3)
    return chat.append_turns(stored, turns(t).unionAll(turns(t)))


@query("session_upsert", """
SELECT 'session_' || user_id AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written_at, event_id, event_type AS history
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def session_upsert(t):
    writes = t.events.select(F.concat(F.lit("session_"), "user_id").alias("session_id"), F.col("ts").alias("written_at"),
                             "event_id", F.col("event_type").alias("history"))
    is_update = F.col("history").isin("purchase", "click")
    last = chat.upsert_sessions(writes.filter(~is_update), writes.filter(is_update), order=("written_at", "event_id"))
    return last.withColumn("written_at", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_chat_append", TURNS_CTE + "SELECT session_id, turn, role, text FROM turns")
def stream_chat_append(t):
    target = work_path(t.spark, "turns")
    # Several batches, and all of them again into another number of buckets: nothing is stored twice.
    landed = _landed_turns(t, files=4)
    for buckets in (64, 48):
        chat_stream.stream_chat_append(landed, target, work_path(t.spark, "stream"), buckets).awaitTermination()
    return chat_stream.stored_turns(t.spark, target)


@query("stream_session_upsert", TURNS_CTE + """
SELECT session_id, turn // 1000 AS part, string_agg(line, chr(10) ORDER BY turn) AS history FROM turns GROUP BY ALL""")
def stream_session_upsert(t):
    target, histories = work_path(t.spark, "turns"), work_path(t.spark, "histories")
    chat_stream.stream_session_upsert(
        _landed_turns(t, files=4), target, histories, work_path(t.spark, "stream")).awaitTermination()
    return chat_stream.latest_histories(t.spark, histories).withColumn("history", F.array_join("history", "\n"))


# Packed transcripts, read back by their byte ranges: the lines of the sessions that end in 4, in order.
@query("packed_transcripts", TURNS_CTE + """
SELECT session_id, 'CHAT HISTORY (' || session_id || ')' || chr(10) || repeat('-', 50) || chr(10) || string_agg(line, chr(10) ORDER BY turn) || chr(10) AS text
FROM turns WHERE ends_with(session_id, '4') GROUP BY session_id""")
def packed_transcripts(t):
    folder = work_path(t.spark, "transcripts")
    chat.pack_transcripts(turns(t), folder, 8)
    parts = chat.read_transcripts(t.spark, folder, F.col("session_id").endswith("4"))
    # A session that goes on in another file comes in several rows; here they are few.
    whole = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return parts.groupBy("session_id").agg(F.array_join(F.transform(whole, lambda p: p["text"]), "").alias("text"))


# Three batches of parts, the buckets rewritten behind the second and behind the last.
@query("compacted_histories", TURNS_CTE + """
SELECT session_id, turn // 2 AS part, string_agg(line, chr(10) ORDER BY turn) AS history FROM turns GROUP BY ALL""")
def compacted_histories(t):
    histories = work_path(t.spark, "histories")
    for i, turn in enumerate((1, 4, 1000)):
        chat_stream.add_histories(chat.session_history(turns(t).filter(F.col("turn") <= turn), 2), histories, 8)
        if i:
            chat_stream.compact_histories(t.spark, histories, many=1)
    return chat_stream.latest_histories(t.spark, histories).withColumn("history", F.array_join("history", "\n"))


def _landed_turns(t, files):
    """The turns as a stream of so many landed files, one file a batch."""
    landed = work_path(t.spark, "landed")
    t.conversations.repartition(files).write.parquet(landed)
    return as_turns(t.spark.readStream.schema(t.conversations.schema).option("maxFilesPerTrigger", 1).parquet(landed))


def entries(t):
    """Events as typed key-value entries; the kind follows the event type, errors have an unsupported one."""
    k = F.get_json_object("props", "$.k")
    kind = (F.when(F.col("event_type") == "click", "string").when(F.col("event_type") == "view", "hash")
            .when(F.col("event_type") == "purchase", "list").when(F.col("event_type") == "signup", "set")
            .otherwise("stream"))
    return t.events.select(
        F.concat_ws(":", "event_type", "user_id", "event_id").alias("key"), kind.alias("kind"), F.col("props").alias("s"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), k).alias("h"),
        F.array("event_type", k, "event_type").alias("l"),
        F.lit(None).cast("array<struct<member:string,score:double>>").alias("z"),
        (k.cast("bigint") - 50).alias("ttl_s"))


@query("kv_documents", """
WITH e AS (SELECT *, event_type || ':' || user_id || ':' || event_id AS key, props->>'$.k' AS k FROM events)
SELECT CASE event_type
         WHEN 'click' THEN props
         WHEN 'view' THEN '{"k":"' || k || '","user":"' || user_id || '"}'
         WHEN 'purchase' THEN '["purchase","' || k || '","purchase"]'
         ELSE '["' || k || '","signup"]' END AS text,
       key AS file_path, key AS file_name, '' AS file_extension, key AS file_type,
       CASE WHEN k::int > 50 THEN (k::int - 50)::varchar ELSE 'no_expiry' END AS expiry, 'kv' AS data_source_id
FROM e WHERE event_type <> 'error'""")
def kv_documents(t):
    return from_kv(entries(t), "kv")


# Members of equal score go by name; the user's own entry has half the score of the other two.
@query("kv_sorted_sets", """
SELECT '["' || CASE WHEN k = 0 THEN 'a","b","u' || user_id ELSE 'u' || user_id || '","a","b' END || '"]' AS text, 'board:' || event_id AS file_path
FROM (SELECT *, (props->>'$.k')::double AS k FROM events)""")
def kv_sorted_sets(t):
    k = F.get_json_object("props", "$.k").cast("double")
    member = lambda name, score: F.struct(name.alias("member"), score.alias("score"))
    boards = t.events.select(
        F.concat(F.lit("board:"), "event_id").alias("key"), F.lit("zset").alias("kind"), F.lit(None).cast("string").alias("s"),
        F.lit(None).cast("map<string,string>").alias("h"), F.lit(None).cast("array<string>").alias("l"),
        F.array(member(F.lit("b"), k), member(F.concat(F.lit("u"), "user_id"), k / 2), member(F.lit("a"), k)).alias("z"),
        F.lit(None).cast("bigint").alias("ttl_s"))
    return from_kv(boards, "kv").select("text", "file_path")


# Events write entries under their user with the time to live that k gives, in four batches of any order. What has expired
# by the time of the last event is removed, and the same call once more finds nothing.
@query("stream_expiry", """
WITH w AS (SELECT 'user:' || user_id AS key, ts, event_id, (props->>'$.k')::int * 3600 AS ttl FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM w) WHERE n = 1)
SELECT key, event_id, CASE WHEN ts + to_seconds(ttl) > (SELECT max(ts) FROM events) THEN 'live' ELSE 'expired' END AS state FROM last""")
def stream_expiry(t):
    root, landed = work_path(t.spark, "entries"), work_path(t.spark, "landed")
    writes = t.events.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("ts").alias("written_at"), "event_id",
                             (F.get_json_object("props", "$.k").cast("bigint") * 3600).alias("ttl_s"))
    writes.repartition(4).write.parquet(landed)
    stream = t.spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    order = ("written_at", "event_id")
    entry_stream.stream_entries(stream, root, work_path(t.spark, "stream"), order, compact_every=3, buckets=8).awaitTermination()
    now = t.events.agg(F.max("ts")).first()[0]
    gone = entry_stream.expire_entries(t.spark, root, now, order)
    again = entry_stream.expire_entries(t.spark, root, now, order)
    live = entry_stream.live_entries(t.spark, root, now, order)
    states = [(gone, "expired"), (again, "expired again"), (live, "live")]
    return reduce(lambda a, b: a.union(b), [rows.select("key", "event_id", F.lit(state).alias("state")) for rows, state in states])


@query("keyspace_summary", """
SELECT event_type AS prefix, CASE event_type WHEN 'click' THEN 'string' WHEN 'view' THEN 'hash' WHEN 'purchase' THEN 'list'
       WHEN 'signup' THEN 'set' ELSE 'stream' END AS kind, count(*) AS n_keys FROM events GROUP BY ALL""")
def keyspace_summary(t):
    return keyspace.keyspace_summary(entries(t))


# Every event scores once on its type's board; k has few values, so most scores are shared.
@query("zset_order", """
SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) AS place
FROM (SELECT event_type AS key, user_id || '/' || event_id AS member, (props->>'$.k')::double AS score FROM events)""")
def zset_order(t):
    members = t.events.select(
        F.col("event_type").alias("key"), F.concat_ws("/", "user_id", "event_id").alias("member"),
        F.get_json_object("props", "$.k").cast("double").alias("score"))
    return keyspace.zset_order(members).select("key", "member", "score", "place")


@query("set_members", "SELECT DISTINCT event_type AS key, user_id::varchar AS member FROM events")
def set_members(t):
    return keyspace.set_members(t.events.select(
        F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")))


@query("latest_n_per_user", """
SELECT user_id, event_id, place FROM (
  SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::int AS place FROM events)
WHERE place <= 20""")
def latest_n_per_user(t):
    newest = newest_per(t.events.select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 20)
    return newest.select("user_id", "event_id", "place")


# An assistant turn counts as a repost of the turn before it.
@query("repost_text", """
SELECT a.conv_id, a.turn, CASE WHEN b.role IS NOT NULL THEN 'RT @' || b.role || ': ' || b.text ELSE a.text END AS text,
       CASE WHEN b.role IS NOT NULL THEN 'retweet' ELSE 'tweet' END AS content_type
FROM conversations a LEFT JOIN conversations b
  ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND a.role = 'assistant'""")
def repost_text(t):
    posts = t.conversations
    originals = posts.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"),
                             F.col("role").alias("o_user"), F.col("text").alias("o_text"))
    return posts.join(originals, ["conv_id", "turn", "role"], "left").select(
        "conv_id", "turn", post_text(F.col("text"), F.col("o_user"), F.col("o_text")).alias("text"),
        post_type(F.col("o_user")).alias("content_type"))


@query("issue_documents", """
WITH i AS (SELECT 'ORD-' || o_orderkey AS issue_key, 'Order of customer ' || o_custkey AS summary,
  CASE WHEN o_orderstatus <> 'P' THEN 'total ' || o_totalprice::decimal(14,2) END AS description,
  o_orderpriority AS issue_type, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders)
SELECT 'Issue Key: ' || issue_key || chr(10) || 'Summary: ' || summary || chr(10) || 'Description: ' || coalesce(description, 'None')
       || chr(10) || 'Issue Type: ' || issue_type || chr(10) || 'Status: ' || status || chr(10) || 'Created: ' || created
       || chr(10) || 'Updated: ' || created AS text,
  issue_key, summary, lower(issue_type) AS issue_type, status, created, created AS updated,
  CASE WHEN status = 'F' THEN NULL ELSE 'desk ' || status END AS assignee, summary AS reporter, 'orders' AS data_source_id
FROM i""")
def issue_documents(t):
    return from_issues(landed_issues(t), "orders")


@query("issue_ingest", """
WITH i AS (SELECT 'ORD-' || o_orderkey AS issue_key, 'Order of customer ' || o_custkey AS summary,
  CASE WHEN o_orderstatus <> 'P' THEN 'total ' || o_totalprice::decimal(14,2) END AS description,
  o_orderpriority AS issue_type, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders)
SELECT issue_key, lower(status) AS status, lower(issue_type) AS issue_type, 0 AS chunk_no,
       'Issue Key: ' || issue_key || chr(10) || 'Summary: ' || summary || chr(10) || 'Description: ' || description
       || chr(10) || 'Issue Type: ' || issue_type || chr(10) || 'Status: ' || status || chr(10) || 'Created: ' || created
       || chr(10) || 'Updated: ' || created AS text
FROM i WHERE status <> 'P'""")
def issue_ingest(t):
    root = work_path(t.spark, "index")
    source = ReaderSource(lambda spark: from_issues(landed_issues(t), "orders"), "orders", ("issue_key",),
                          enrich=lambda docs: lower_key(docs, "status"))
    run_ingest(t.spark, source, collection_sink(root, "issues"), TaskLog(t.spark, work_path(t.spark, "log")), "issues",
               exclude=[r"\nStatus: P\n"])
    nodes = open_collection(t.spark, root, "issues")
    return nodes.select(*[F.col("metadata")[k].alias(k) for k in ("issue_key", "status", "issue_type")], "chunk_no", "text")


# Posts of the three roles as users; an assistant's turn reposts the turn before it.
@query("post_documents", """
SELECT CASE WHEN b.role IS NOT NULL THEN 'RT @' || b.role || ': ' || b.text ELSE a.text END AS text, a.conv_id * 100000 + a.turn AS post_id,
       a.role AS user, CASE WHEN b.role IS NOT NULL THEN 'retweet' ELSE 'tweet' END AS content_type, 'posts' AS data_source_id
FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS place FROM conversations) a
LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND a.role = 'assistant' WHERE place <= 100""")
def post_documents(t):
    turns = t.conversations
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"),
                          F.struct(F.col("role").alias("user"), "text").alias("original"))
    posts = turns.join(before, ["conv_id", "turn", "role"], "left").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("post_id"), F.col("conv_id").alias("created_at"), F.col("role").alias("user"),
        "text", "original", F.lit(0).alias("retweet_count"), F.lit(0).alias("favorite_count"))
    return from_posts(posts, "posts", 100).select("text", "post_id", "user", "content_type", "data_source_id")


def landed_issues(t):
    summary = F.concat(F.lit("Order of customer "), "o_custkey")
    status = F.col("o_orderstatus")
    total = F.concat(F.lit("total "), F.col("o_totalprice").cast("decimal(14,2)"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(F.concat(F.lit("ORD-"), "o_orderkey").alias("key"), F.struct(
        summary.alias("summary"), F.when(status != "P", total).alias("description"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("issuetype"),
        F.struct(status.alias("name")).alias("status"), day.alias("created"), day.alias("updated"),
        F.when(status != "F", F.struct(F.concat(F.lit("desk "), status).alias("displayName"))).alias("assignee"),
        F.struct(summary.alias("displayName")).alias("reporter")).alias("fields"))


@query("task_status", """
SELECT task_id, status, n_entries, elapsed_s FROM (
  SELECT user_id::varchar AS task_id, event_type AS status, count(*) OVER (PARTITION BY user_id) AS n_entries,
    round((epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6, 3) AS elapsed_s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def task_status(t):
    log = t.events.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("status"),
                          F.col("ts").alias("at"), "event_id")
    return latest_status(log, ("at", "event_id")).withColumn("elapsed_s", F.round("elapsed_s", 3))
