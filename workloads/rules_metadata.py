"""Rules, paths, metadata and filters."""

import warnings

from pyspark.sql import functions as F, types as T

from docflow.functions import paths
from docflow.operators import metadata, quality, rules, ruletable
from docflow.operators.joins import missing_keys, skew_join
from docflow.sources.listings import from_repo
from workloads.registry import query

# The url without scheme, query and fragment stands in for a file path.
PATH_SQL = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(t):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    return t.pages.select("page_id", path.alias("file_path"))


def page_files(t):
    return metadata.with_path_parts(page_paths(t))


PARTS_CTE = rf"""
WITH p AS (SELECT page_id, {PATH_SQL} AS file_path FROM pages),
n AS (SELECT *, split_part(file_path, '/', -1) AS file_name FROM p),
parts AS (
  SELECT *, CASE WHEN contains(file_name, '.') THEN lower(split_part(file_name, '.', -1)) ELSE '' END AS file_extension,
         lower(regexp_extract(file_name, '[^.].*\.([^.]*)$', 1)) AS file_stem_extension,
         lower(split_part(file_name, '.', -1)) AS file_type
  FROM n)
"""


@query("path_parts", PARTS_CTE + """
SELECT page_id, file_path, file_name, file_extension, file_stem_extension, file_type FROM parts""")
def path_parts(t):
    return page_files(t)


@query("with_source", PARTS_CTE + """
SELECT page_id, file_path, 'web' AS data_source_id, file_type FROM parts""")
def with_source(t):
    return metadata.with_source(page_files(t), "web").select("page_id", "file_path", "data_source_id", "file_type")


@query("with_processing_method", PARTS_CTE + """
SELECT page_id, 'web' AS data_source_id, file_type, 'html_lines' AS processing_method FROM parts""")
def with_processing_method(t):
    return metadata.with_source(page_files(t), "web", "html_lines").select(
        "page_id", "data_source_id", "file_type", "processing_method")


@query("modified_at", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_epoch, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_iso,
       CASE WHEN event_type = 'view' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS from_blank
FROM events""")
def modified_at(t):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")

    def shown(value, form):
        return F.date_format(paths.modified_at(value, form), "yyyy-MM-dd HH:mm:ss")

    return t.events.select(
        "event_id", shown(F.unix_micros(ts) / 1_000_000, "epoch").alias("from_epoch"),
        shown(iso, "iso").alias("from_iso"),
        F.substring(shown(F.when(F.col("event_type") == "view", "").otherwise(iso), "iso"), 1, 10).alias("from_blank"))


@query("prune_metadata", """
SELECT event_id, user_id::varchar AS user_id, json_extract_string(props, '$.k') AS k,
       (2)::int AS n_keys FROM events""")
def prune_metadata(t):
    entries = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"),
        F.lit("k"), F.get_json_object("props", "$.k"))
    pruned = metadata.prune_metadata(t.events.select("event_id", entries.alias("metadata")), ["user_id", "k"])
    return pruned.select("event_id", F.col("metadata")["user_id"].alias("user_id"), F.col("metadata")["k"].alias("k"),
                         F.size("metadata").alias("n_keys"))


@query("default_key", """
SELECT d.doc_id, coalesce(l.quality::varchar, 'unrated') AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def default_key(t):
    rated = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return metadata.default_key(rated, "quality", "unrated")


REPOSITORY = rules.PRESETS["repository"]


@query("apply_rules_path", rf"""
WITH p AS (SELECT page_id, {PATH_SQL} AS file_path FROM pages)
SELECT page_id, file_path FROM p
WHERE regexp_matches(file_path, '/(en|fr)/') AND NOT regexp_matches(file_path, '^blog\.|\.html$')
  AND NOT regexp_matches(file_path, '(^|/)tests?/|__pycache__|\.md$|\.png$|\.jpg$|\.jpeg$')""")
def apply_rules_path(t):
    return rules.apply_rules(page_paths(t), "file_path", [r"/en/", r"/fr/"], REPOSITORY + [r"^blog\.", r"\.html$"])


@query("apply_rules_issue", """
SELECT p_partkey, upper(p_type) || '-' || replace(p_brand, '#', '') AS issue_key FROM part
WHERE NOT regexp_matches(upper(p_type) || '-' || replace(p_brand, '#', ''), '^SMALL-|-Brand1$|^TEST-|-BUG$|^EPIC-')""")
def apply_rules_issue(t):
    key = F.concat(F.upper("p_type"), F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return rules.apply_rules(t.part.select("p_partkey", key.alias("issue_key")), "issue_key",
                             exclude=rules.PRESETS["issues"] + [r"^SMALL-", r"-Brand1$"])


@query("apply_rules_text", """
SELECT doc_id, length(text)::int AS n_chars FROM documents
WHERE NOT regexp_matches(text, 'https?://[!-~]') AND NOT contains(text, 'RT @')
  AND NOT regexp_matches(text, '[@#][A-Za-z0-9_]')""")
def apply_rules_text(t):
    kept = rules.apply_rules(t.documents.select("doc_id", "text"), "text", exclude=rules.PRESETS["posts"])
    return kept.select("doc_id", F.length("text").alias("n_chars"))


# Every page path becomes a note, some of them in folders the vault rules leave out.
VAULT_SQL = f"""
WITH p AS (SELECT page_id, {PATH_SQL} AS file_path FROM pages),
notes AS (SELECT page_id, CASE WHEN contains(file_path, 'blog.') THEN 'v/.trash/' WHEN contains(file_path, 'www.') THEN 'v/_draft/'
            WHEN contains(file_path, '/es/') THEN 'v/temp/' ELSE 'v/' END
            || file_path || CASE WHEN contains(file_path, 'html') THEN '' ELSE '.md' END AS file_path FROM p)
"""


@query("apply_rules_vault", VAULT_SQL + r"""
SELECT page_id, file_path FROM notes
WHERE ends_with(file_path, '.md') AND NOT regexp_matches(file_path, '/\.trash/|/temp/|/_|\.git/')""")
def apply_rules_vault(t):
    path = F.col("file_path")
    folder = (F.when(path.contains("blog."), "v/.trash/").when(path.contains("www."), "v/_draft/")
              .when(path.contains("/es/"), "v/temp/").otherwise("v/"))
    note = F.concat(folder, path, F.when(path.contains("html"), "").otherwise(".md"))
    notes = page_paths(t).select("page_id", note.alias("file_path"))
    notes = notes.withColumn("file_extension", paths.file_extension(paths.file_name(F.col("file_path"))))
    return rules.apply_vault_rules(notes, rules.VAULT_INCLUDE, rules.PRESETS["vault"]).select("page_id", "file_path")


@query("apply_rules_supported", PARTS_CTE + """
SELECT page_id, file_path FROM parts
WHERE file_extension IN ('pdf', 'docx', 'pptx', 'html', 'txt') AND NOT contains(file_path, '/de/')""")
def apply_rules_supported(t):
    return rules.apply_supported_rules(page_files(t), exclude=["/de/"]).select("page_id", "file_path")


@query("apply_substring_rules", PARTS_CTE + """
SELECT page_id, file_path FROM parts
WHERE NOT contains(lower(file_path), 'blog')
  AND (contains(lower(file_path), 'example.com') OR contains(lower(file_path), '/es/'))""")
def apply_substring_rules(t):
    return rules.apply_substring_rules(page_files(t), ["EXAMPLE.com", "/ES/"], ["Blog"]).select("page_id", "file_path")


@query("rules_skip_invalid", f"""
WITH p AS (SELECT page_id, {PATH_SQL} AS file_path FROM pages)
SELECT page_id, file_path FROM p WHERE NOT contains(file_path, '/en/')""")
def rules_skip_invalid(t):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return rules.apply_rules(page_paths(t), "file_path", ["("], ["[", "[[]", r"/en/"])


# A rule per benchmark text, its first letters, and some more: few by their number, a join whatever it is.
@query("rule_table", """
SELECT doc_id, text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, substr(b.text, 1, 16))) AND NOT regexp_matches(text, '@[a-z]+')
  AND EXISTS (SELECT 1 FROM labels l WHERE contains(d.text, (l.doc_id % 97)::varchar || ' ') OR contains(d.text, 'the ') OR contains(d.text, 'de '))""")
def rule_table(t):
    literal = F.regexp_replace(F.substring("text", 1, 16), r"([\\^$.|?*+()\[\]{}-])", r"\\$1")
    refused = t.benchmark.select(literal.alias("pattern"), F.lit(True).alias("exclude"))
    asked = t.labels.select(F.concat((F.col("doc_id") % 97).cast("string"), F.lit(" ")).alias("pattern"), F.lit(False).alias("exclude"))
    more = t.spark.createDataFrame([("@[a-z]+", True), ("the ", False), ("de ", False), ("(", True)], "pattern string, exclude boolean")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ruletable.apply_rule_table(t.documents.select("doc_id", "text"), "text", refused.union(asked).union(more))


@query("repo_skip_dirs_exts", PARTS_CTE + """
SELECT page_id, file_path FROM parts
WHERE NOT list_contains(string_split(file_path, '/')[:-2], 'en') AND file_stem_extension NOT IN ('html', 'png')""")
def repo_skip_dirs_exts(t):
    return from_repo(page_paths(t), ["en", "dist"], [".html", ".png"])


@query("drop_blank", """
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''""")
def drop_blank(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return quality.drop_blank(lines, "line").withColumn("line_no", F.col("line_no").cast("bigint"))


@query("item_kind_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def item_kind_filter(t):
    return t.events.filter(F.col("event_type") == "click").select("event_id", "user_id")


# Part of the records lose their closing brace, so there is something to set aside.
@query("quarantine_bad", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE (props->>'$.k')::bigint END AS k,
       CASE WHEN event_type = 'error' THEN 'malformed' END AS error FROM events""")
def quarantine_bad(t):
    raw = F.when(F.col("event_type") == "error", F.rtrim("props", F.lit("}"))).otherwise(F.col("props"))
    record = T.StructType([T.StructField("k", T.LongType())])
    parsed = quality.parse_json(t.events.select("event_id", raw.alias("props")), "props", record)
    good, bad = quality.quarantine(parsed)
    return good.select("event_id", F.col("parsed.k").alias("k"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.col("_error").alias("error")))


@query("exact_null_filter", """
SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.source = 'src3' AND l.quality IS NULL""")
def exact_null_filter(t):
    docs = t.documents.filter(F.col("source") == "src3").select("doc_id", "source")
    return (docs.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            .filter(F.col("quality").isNull()).select("doc_id", "source"))


@query("unexpired_keys", """
SELECT event_id, key, ttl_s FROM (
  SELECT event_id, event_type || ':' || event_id AS key, ts,
         CASE WHEN event_type <> 'view' THEN (props->>'$.k')::bigint * 3600 END AS ttl_s FROM events)
WHERE ttl_s IS NULL OR ts + to_seconds(ttl_s) > TIMESTAMP '2024-01-16 00:00:00'""")
def unexpired_keys(t):
    ttl = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("bigint") * 3600)
    entries = t.events.select("event_id", F.concat_ws(":", "event_type", "event_id").alias("key"),
                              F.col("ts").cast("timestamp").alias("written_at"), ttl.alias("ttl_s"))
    as_of = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    return quality.unexpired(entries, as_of).select("event_id", "key", "ttl_s")


@query("explicit_join", """
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey""")
def explicit_join(t):
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    # So few rows make a key hot that the busiest buyers' orders are cut into pieces.
    return skew_join(orders, buyers, "o_custkey", hot_rows=15).select("o_orderkey", "c_name", "o_totalprice")


@query("missing_keys", """
SELECT o_custkey, count(*) AS n_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""")
def missing(t):
    return missing_keys(t.orders, t.customer.filter(F.col("c_acctbal") > 0), "o_custkey", "c_custkey")


@query("constraint_report", """
SELECT 'order_key_unique' AS check_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'line_key_unique', (SELECT count(*) FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'line_has_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'line_has_small_part', (SELECT count(*) FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25))
UNION ALL SELECT 'customer_set', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)""")
def constraint_report(t):
    return quality.constraint_report([
        ("order_key_unique", "unique", t.orders, ["o_orderkey"]),
        ("line_key_unique", "unique", t.lineitem, ["l_orderkey", "l_linenumber"]),
        ("line_has_order", "reference", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ("line_has_small_part", "reference", t.lineitem, "l_partkey", t.part.filter(F.col("p_size") <= 25), "p_partkey"),
        ("customer_set", "not_null", t.orders, "o_custkey"),
    ])


@query("status_pivot", """
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
       count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_custkey""")
def status_pivot(t):
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"]
    return t.orders.groupBy("o_custkey").agg(*counts)


@query("preview_docs", "SELECT doc_id, text[1:50] AS preview FROM documents ORDER BY doc_id LIMIT 10")
def preview_docs(t):
    return metadata.preview(t.documents, "doc_id")


@query("select_columns", "SELECT doc_id, source, text FROM documents")
def select_columns(t):
    return t.documents.select("doc_id", "source", "text")


@query("positional_columns", """
SELECT c_custkey AS Col0, c_name AS Col1, c_nationkey AS Col2, c_acctbal AS Col3, c_mktsegment AS Col4 FROM customer""")
def positional_columns(t):
    return metadata.positional(t.customer)


@query("shape_rows", """
SELECT to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey, 's_acctbal': s_acctbal})::varchar AS result
FROM supplier""")
def shape_rows(t):
    return metadata.shape_result(t.supplier)


@query("shape_nothing", "SELECT 'No results found' AS result FROM (SELECT count(*) AS n FROM supplier WHERE s_suppkey < 0) WHERE n = 0")
def shape_nothing(t):
    return metadata.shape_result(t.supplier.filter("s_suppkey < 0"))


@query("shape_single", "SELECT count(*)::varchar AS result FROM supplier")
def shape_single(t):
    return metadata.shape_result(t.supplier.agg(F.count("*").alias("n")))


@query("top_n_recent", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def top_n_recent(t):
    newest = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return newest.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
