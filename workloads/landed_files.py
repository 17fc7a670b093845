"""Landed listings, contents and written files. Pages and documents stand in for the files of a source."""

import uuid

from pyspark.sql import functions as F

from docflow.functions import paths
from docflow.operators import chat, chunk, collections
from docflow.plans.sync import sync_folder
from docflow.session import spread, task_files, work_path
from docflow.sources import files, listings
from docflow.streaming.ingest import landed_files, stream_ingest, stream_update
from workloads.chat_keys import TURNS_CTE, turns
from workloads.registry import query
from workloads.rules_metadata import PATH_SQL, page_paths
from workloads.text_search import chunk_cte, html_sql

def land(rows, folder, gone=None):
    """Write rows (name, content) as files of a folder, each by the task that has it; delete those that `gone` names."""
    def write(batches):
        for batch in batches:
            system, place = task_files(folder)
            for name, content in zip(batch["name"], batch["content"]):
                path = f"{place}/{name}"
                if content is None:
                    system.delete_file(path)
                    continue
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as file:
                    file.write(content)
            yield batch[["name"]]

    rows = rows.select("name", F.col("text").cast("binary").alias("content"))
    if gone is not None:
        rows = rows.union(gone.select("name", F.lit(None).cast("binary")))
    rows.mapInPandas(write, "name string").count()


def note_name():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")


def name_of_file():
    return F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1).alias("name")


FOLDER_SQL = f"{PATH_SQL} || '/' || page_id AS file_path"


def landed_pages(t):
    """Path, name and address of every page, and its content under that path."""
    path = F.concat("file_path", F.lit("/"), F.col("page_id").cast("string"))
    listed = page_paths(t).join(t.pages.select("page_id", "url"), "page_id").select(
        path.alias("path"), F.concat(F.col("page_id").cast("string"), F.lit(".HTML")).alias("name"), "url")
    contents = page_paths(t).join(t.pages.select("page_id", "html"), "page_id").select(
        path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return listed, contents


# Documents in French were saved as Latin-1, those of two sources without a text extension.
@query("decode_cascade", """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'bin' ELSE 'txt' END AS file_extension, text FROM documents
WHERE NOT (source IN ('src3') AND lang = 'fr' AND strlen(text) > length(text))""")
def decode_cascade(t):
    text = F.col("text")
    content = F.when(F.col("lang") == "fr", F.encode(text, "ISO-8859-1")).otherwise(
        F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(text, "UTF-8")))
    saved = t.documents.select(
        "doc_id", F.when(F.col("source") == "src3", "bin").otherwise("txt").alias("file_extension"), content.alias("content"))
    return files.decode_cascade(saved)


@query("extract_by_extension", f"""
SELECT 'p' || page_id AS id, 'html' AS file_extension, {html_sql()} AS text FROM pages
UNION ALL SELECT 'd' || doc_id, 'txt', text FROM documents""")
def extract_by_extension(t):
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.lit("html").alias("file_extension"),
                           F.encode("html", "UTF-8").alias("content"))
    notes = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("txt").alias("file_extension"),
                               F.encode("text", "UTF-8").alias("content"))
    return files.extract_text(pages.unionByName(notes)).select("id", "file_extension", "text")


@query("repo_tree_documents", f"""
SELECT {FOLDER_SQL}, page_id || '.HTML' AS file_name, 'html' AS file_extension, '2024-05-01' AS day, html AS text
FROM pages WHERE starts_with(url, 'https')""")
def repo_tree_documents(t):
    listed, contents = landed_pages(t)
    tree = listed.select(F.when(F.col("url").startswith("https"), "blob").otherwise("tree").alias("type"), "path", "name",
                         F.lit("2024-05-01T10:00:00").alias("committed_date"))
    return listings.from_repo_tree(tree, contents).select(
        "file_path", "file_name", "file_extension", F.date_format("last_modified", "yyyy-MM-dd").alias("day"), "text")


# The same tree, its contents landed in buckets of their path.
@query("bucketed_tree_documents", f"""
SELECT {FOLDER_SQL}, 'html' AS file_extension, html AS text FROM pages WHERE starts_with(url, 'https')""")
def bucketed_tree_documents(t):
    listed, contents = landed_pages(t)
    table = f"contents_{uuid.uuid4().hex}"
    listings.land_contents(contents, table, 8, work_path(t.spark, "contents"))
    tree = listed.select(F.when(F.col("url").startswith("https"), "blob").otherwise("tree").alias("type"), "path", "name",
                         F.lit("2024-05-01T10:00:00").alias("committed_date"))
    return listings.from_repo_tree(tree, t.spark.table(table), 8).select("file_path", "file_extension", "text")


@query("drive_documents", f"""
SELECT {FOLDER_SQL}, 'html' AS file_extension, html AS text FROM pages WHERE NOT contains(url, '/es/')""")
def drive_documents(t):
    listed, contents = landed_pages(t)
    entries = listed.select(F.when(F.col("url").contains("/es/"), "folder").otherwise("file").alias("tag"),
                            F.col("path").alias("path_display"), "name", F.lit("").alias("client_modified"))
    return listings.from_drive_listing(entries, contents).select("file_path", "file_extension", "text")


@query("flat_drive_documents", """
SELECT page_id || '.HTML' AS file_path, 'html' AS file_extension, html AS text FROM pages
WHERE starts_with(url, 'https') AND NOT contains(url, '#')""")
def flat_drive_documents(t):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".HTML"))
    items = t.pages.select(
        name.alias("name"), F.when(F.col("url").startswith("https"), F.struct(F.lit("text/html").alias("mimeType"))).alias("file"),
        F.when(~F.col("url").contains("#"), F.col("url")).alias("download_url"), F.lit("").alias("lastModifiedDateTime"))
    contents = t.pages.select(name.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return listings.from_graph_items(items, contents).select("file_path", "file_extension", "text")


# Entries whose content never arrived, here those of the pages with an anchor.
@query("missing_contents", f"""
SELECT {FOLDER_SQL}, 'content missing' AS error FROM pages WHERE contains(url, '#')""")
def missing_contents(t):
    listed, contents = landed_pages(t)
    arrived = contents.join(listed.filter(~F.col("url").contains("#")).select("path"), "path", "left_semi")
    found = listings.with_content(listed.select(F.col("path").alias("file_path")), arrived)
    return found.filter("_error is not null").select("file_path", F.col("_error").alias("error"))


def broken_pages(t):
    """Landed pages of which those with an anchor never arrived and the French ones are not UTF-8."""
    listed, contents = landed_pages(t)
    urls = listed.select("path", "url").filter(~F.col("url").contains("#"))
    bad = F.concat(F.lit(bytearray(b"\xff")), F.col("content"))
    return listed, contents.join(urls, "path").select(
        "path", F.when(F.col("url").contains("/fr/"), bad).otherwise(F.col("content")).alias("content"))


def outcome_sql(condition, unreadable):
    return f"""
SELECT page_id || '.HTML' AS file_name, CASE WHEN contains(url, '#') THEN 'content missing' WHEN contains(url, '/fr/') THEN '{unreadable}' END AS error,
       CASE WHEN NOT contains(url, '#') AND NOT contains(url, '/fr/') THEN html END AS text FROM pages WHERE {condition}"""


@query("repo_tree_outcomes", outcome_sql("starts_with(url, 'https')", "not UTF-8"))
def repo_tree_outcomes(t):
    listed, contents = broken_pages(t)
    tree = listed.select(F.when(F.col("url").startswith("https"), "blob").otherwise("tree").alias("type"), "path", "name",
                         F.lit("2024-05-01T10:00:00").alias("committed_date"))
    return listings.repo_tree_results(tree, contents).select("file_name", F.col("_error").alias("error"), "text")


@query("drive_outcomes", outcome_sql("NOT contains(url, '/es/')", "not UTF-8, no reader"))
def drive_outcomes(t):
    listed, contents = broken_pages(t)
    entries = listed.select(F.when(F.col("url").contains("/es/"), "folder").otherwise("file").alias("tag"),
                            F.col("path").alias("path_display"), "name", F.lit("").alias("client_modified"))
    return listings.drive_results(entries, contents).select("file_name", F.col("_error").alias("error"), "text")


@query("flat_drive_outcomes", outcome_sql("starts_with(url, 'https')", "not UTF-8"))
def flat_drive_outcomes(t):
    listed, contents = broken_pages(t)
    items = listed.select(F.col("path").alias("name"), "url").select(
        "name", F.when(F.col("url").startswith("https"), F.struct(F.lit("text/html").alias("mimeType"))).alias("file"),
        F.col("url").alias("download_url"), F.lit("").alias("lastModifiedDateTime"))
    found = listings.graph_results(items, contents)
    return found.select(F.element_at(F.split("file_name", "/"), -1).alias("file_name"), F.col("_error").alias("error"), "text").withColumn(
        "file_name", F.concat("file_name", F.lit(".HTML")))


@query("persisted_index", chunk_cte(256, 20) + """
SELECT doc_id::varchar AS ref_doc_id, (chunk_no // 1000)::bigint AS part, count(*) AS n_nodes,
       string_agg(sha256(doc_id || '#' || chunk_no), ',' ORDER BY chunk_no) AS node_ids FROM chunks GROUP BY ALL""")
def persisted_index(t):
    root = work_path(t.spark, "persisted")
    docs = spread(t.documents.select("doc_id", "text"))
    collections.persist_index(chunk.with_lineage(chunk.chunk_words(docs, 256, 20)), root)
    info = t.spark.read.parquet(f"{root}/ref_doc_info")
    return info.select("ref_doc_id", "part", F.size("node_ids").cast("bigint").alias("n_nodes"),
                       F.array_join("node_ids", ",").alias("node_ids"))


@query("file_extensions", f"""
SELECT page_id, lower(regexp_extract(p, '[^.].*\\.([^.]*)$', 1)) AS file_extension FROM (
  SELECT page_id, split_part({PATH_SQL}, '/', -1) AS p FROM pages)
WHERE file_extension IN ('pdf', 'docx', 'pptx', 'html', 'txt')""")
def file_extensions(t):
    named = page_paths(t).withColumn("file_extension", paths.splitext(paths.file_name(F.col("file_path"))))
    return named.filter(F.col("file_extension").isin(*files.SUPPORTED_EXTENSIONS)).select("page_id", "file_extension")


def exported(t):
    folder = work_path(t.spark, "transcripts")
    chat.export_transcripts(turns(t), folder)
    return folder


def session_of_file():
    return F.regexp_extract("file_path", r"session_id=(session_[0-9]+)/", 1).alias("session_id")


LINES_CTE = TURNS_CTE + """
, lines AS (SELECT session_id, line FROM turns
  UNION ALL SELECT DISTINCT session_id, 'CHAT HISTORY (' || session_id || ')' FROM turns
  UNION ALL SELECT DISTINCT session_id, repeat('-', 50) FROM turns)
"""


@query("transcript_files", LINES_CTE + "SELECT session_id, unnest(string_split(line, chr(10))) AS line FROM lines")
def transcript_files(t):
    return t.spark.read.text(exported(t), lineSep="\n").select("session_id", F.col("value").alias("line"))


# Transcripts as a folder of files; a long session may have several of them.
@query("folder_scan", LINES_CTE + """
SELECT session_id, sum(strlen(line) + 1)::bigint AS n_bytes FROM lines WHERE NOT ends_with(session_id, '3') GROUP BY session_id""")
def folder_scan(t):
    kept = files.read_files(t.spark, exported(t), ["txt"], ~F.col("file_path").rlike(r"session_[0-9]*3/"))
    return kept.groupBy(session_of_file()).agg(F.sum("file_size").alias("n_bytes"))


@query("stream_file_ingest", LINES_CTE + r"""
SELECT session_id, sum(len(regexp_extract_all(line, '\S+')))::bigint AS n_words FROM lines GROUP BY session_id""")
def stream_file_ingest(t):
    root = work_path(t.spark, "index")

    def cut(batch):
        docs = files.extract_text(batch).withColumn("doc_id", F.sha2("file_path", 256))
        return chunk.with_lineage(chunk.chunk_words(docs, 512, 0))

    landed = landed_files(t.spark, exported(t), "*.txt")
    stream_ingest(landed, cut, root, "transcripts", work_path(t.spark, "stream")).awaitTermination()
    stored = collections.open_collection(t.spark, root, "transcripts")
    return stored.groupBy(session_of_file()).agg(F.sum("n_words").alias("n_words"))


# A folder of notes in three states: without one source and with another one changed; as it should be; with a third one deleted.
@query("folder_sync", chunk_cte(256, 20, "SELECT source || '/' || doc_id || '.txt' AS doc_id, text FROM documents WHERE source <> 'src7'") + """
SELECT doc_id AS name, chunk_no, text FROM chunks
UNION ALL
SELECT 'run ' || n, 0, CASE n WHEN 1 THEN b - x5 || ' added, 0 changed, 0 removed' WHEN 2 THEN x5 || ' added, ' || x3 || ' changed, 0 removed'
                              WHEN 3 THEN '0 added, 0 changed, ' || x7 || ' removed' ELSE '0 added, 0 changed, 0 removed' END
FROM range(1, 5) r(n), (SELECT count(*) AS b, count(*) FILTER (source = 'src5') AS x5, count(*) FILTER (source = 'src3') AS x3,
                               count(*) FILTER (source = 'src7') AS x7 FROM documents)""")
def folder_sync(t):
    root, folder = work_path(t.spark, "index"), work_path(t.spark, "notes")
    notes = spread(t.documents.select("source", "doc_id", note_name(), "text"))
    runs = []

    def run():
        counts = sync_folder(t.spark, folder, root, "notes", extensions=["txt"], key=lambda path: F.regexp_extract(path, r"([^/]+/[^/]+)$", 1),
                             cut=lambda docs: chunk.with_lineage(chunk.chunk_words(docs, 256, 20)), buckets=8)
        runs.append((f"run {len(runs) + 1}", 0, ", ".join(f"{n} {kind}" for kind, n in counts.items())))

    land(notes.filter("source <> 'src5'").withColumn("text", F.when(F.col("source") == "src3", F.concat(F.lit("draft "), "text")).otherwise(F.col("text"))), folder)
    run()
    land(notes.filter("source in ('src3', 'src5')"), folder)
    run()
    land(notes.limit(0), folder, gone=notes.filter("source = 'src7'"))
    run()
    run()
    stored = collections.open_collection(t.spark, root, "notes").select(name_of_file(), "chunk_no", "text")
    return stored.union(t.spark.createDataFrame(runs, "name string, chunk_no int, text string"))


# Notes land twice, the second time below another folder and changed; the last one of each counts.
@query("stream_file_update", chunk_cte(256, 20, "SELECT source || '/' || doc_id || '.txt' AS doc_id, text FROM documents") + """
SELECT doc_id AS name, chunk_no, text FROM chunks""")
def stream_file_update(t):
    root, folder, checkpoint = (work_path(t.spark, name) for name in ("index", "notes", "stream"))
    notes = spread(t.documents.select("source", note_name(), "text"))

    def to_docs(batch):
        return files.extract_text(batch).withColumn("doc_id", name_of_file())

    def cut(docs):
        return chunk.with_lineage(chunk.chunk_words(docs, 256, 20))

    early = notes.filter("source <> 'src5'").withColumn("text", F.when(F.col("source") == "src3", F.upper("text")).otherwise(F.col("text")))
    for day, rows in (("1", early), ("2", notes.filter("source in ('src3', 'src5')"))):
        land(rows.withColumn("name", F.concat(F.lit(f"day{day}/"), "name")), folder)
        stream_update(landed_files(t.spark, folder, "*.txt"), to_docs, cut, root, "notes", checkpoint, compact_every=2, buckets=8).awaitTermination()
    return collections.open_collection(t.spark, root, "notes").select(F.col("doc_id").alias("name"), "chunk_no", "text")


# Pages as notes of a vault; the French ones are not UTF-8 and are left out, as are files with another extension.
@query("vault_documents", """
SELECT page_id || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.MD' END AS file_name, 'md' AS file_extension, html AS text
FROM pages WHERE NOT contains(url, '/fr/') AND NOT contains(url, '/es/')""")
def vault_documents(t):
    folder = work_path(t.spark, "vault")
    page = F.col("page_id").cast("string")
    ending = F.when(F.col("url").contains("/es/"), ".txt").when(F.col("page_id") % 2 == 0, ".md").otherwise(".MD")
    content = F.when(F.col("url").contains("/fr/"), F.concat(F.lit(bytearray(b"\xff")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    land(t.pages.select(F.concat(F.lit("notes/"), page, ending).alias("name"), content.alias("text")), folder)
    return files.read_vault(t.spark, folder).select("file_name", "file_extension", "text")
