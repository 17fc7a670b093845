"""Chunks, vectors, retrieval, collections and whole jobs."""

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from docflow.functions import text as text_functions
from docflow.functions.records import render_node
from docflow.functions.units import pattern_unit
from docflow.functions.vectors import l2_normalise
from docflow.operators import chunk, collections, context
from docflow.operators.chat import memory_window, with_line
from docflow.operators.rules import PRESETS, matches_any, rule_condition
from docflow.operators.similarity import top_k
from docflow.plans import sqljobs
from docflow.plans.embedding import embed as embed_with, embed_hashed
from docflow.plans.ingest import collection_sink, fold, funnel, run_ingest
from docflow.plans.search import attach, search, search_collection as search_stored
from docflow.plans.sync import run_sync
from docflow.plans.tasks import TaskLog
from docflow.session import spread, work_path
from workloads.chat_keys import TURNS_CTE, turns
from workloads.registry import query


def chunk_cte(size, overlap, source="SELECT doc_id, text FROM documents"):
    step = size - overlap
    return rf"""
WITH docs AS ({source}),
toks AS (SELECT *, regexp_extract_all(text, '\S+\s*') AS w, length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS lead FROM docs),
starts AS (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(ceil((len(w) - {overlap}) / {step}.0), 1) END::bigint)) AS i FROM toks),
chunks AS (SELECT doc_id, i::int AS chunk_no,
  rtrim(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text,
  (lead + length(array_to_string(w[1 : i * {step}], '')))::int AS start_char,
  len(w[i * {step} + 1 : i * {step} + {size}])::int AS n_words FROM starts)
"""


CHUNK_ROWS = "SELECT doc_id, chunk_no, text, start_char, (start_char + length(text))::int AS end_char, n_words FROM chunks"


def docs(t):
    return spread(t.documents.select("doc_id", "text"))


@query("chunk_words_512_20", chunk_cte(512, 20) + CHUNK_ROWS)
def chunk_words_512_20(t):
    return chunk.chunk_words(docs(t), 512, 20)


@query("chunk_words_256_20", chunk_cte(256, 20) + CHUNK_ROWS)
def chunk_words_256_20(t):
    return chunk.chunk_words(docs(t), 256, 20)


@query("chunk_words_512_50", chunk_cte(512, 50) + CHUNK_ROWS)
def chunk_words_512_50(t):
    return chunk.chunk_words(docs(t), 512, 50)


# Sentence i of a document has n words and c words end with it. A chunk runs from sentence s to e; the next one
# begins with the last sentences of at most 20 words that leave room for the first new one.
def packed_sql(pieces, size, overlap, where="true", columns="k.doc_id, k.chunk_no, text, start_char, (start_char + length(text))::int AS end_char, n_words"):
    """Chunks of whole pieces, which `pieces` sets apart by chr(1)."""
    return rf"""WITH RECURSIVE chosen AS (SELECT doc_id, text FROM documents WHERE {where}), split AS (
  SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS sn
  FROM (SELECT doc_id, string_split({pieces}, chr(1)) AS l FROM chosen)),
cut AS (SELECT doc_id, sn, t, unnest(range(ceil(len(t) / {size}.0)::bigint)) AS part
        FROM (SELECT *, regexp_extract_all(sentence, '\S+') AS t FROM split)),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sn, part) AS i,
                     t[part * {size} + 1 : part * {size} + {size}] AS t FROM cut),
cum AS (SELECT doc_id, i, len(t) AS n,
               sum(len(t)) OVER (PARTITION BY doc_id ORDER BY i)::bigint AS c FROM sentences),
chunks AS (
  SELECT doc_id, 0 AS chunk_no, 1::bigint AS s, max(i) AS e FROM cum WHERE c <= {size} GROUP BY doc_id
  UNION ALL
  SELECT doc_id, chunk_no + 1, s, (SELECT max(b.i) FROM cum b WHERE b.doc_id = x.doc_id AND b.i >= x.fresh
                                    AND b.c <= {size} + (SELECT a.c - a.n FROM cum a WHERE a.doc_id = x.doc_id AND a.i = x.s))
  FROM (SELECT k.doc_id, k.chunk_no, f.i AS fresh,
               coalesce((SELECT min(a.i) FROM cum a WHERE a.doc_id = k.doc_id AND a.i BETWEEN k.s AND k.e
                           AND f.c - f.n - a.c + a.n <= least({overlap}, {size} - f.n)), f.i) AS s
        FROM chunks k JOIN cum f ON f.doc_id = k.doc_id AND f.i = k.e + 1) x)
SELECT {columns} FROM (
  SELECT k.doc_id, k.chunk_no, (b.c - a.c + a.n)::int AS n_words,
         rtrim(array_to_string(w[a.c - a.n + 1 : b.c], ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text,
         (lead + length(array_to_string(w[1 : a.c - a.n], '')))::int AS start_char
  FROM chunks k JOIN cum a ON a.doc_id = k.doc_id AND a.i = k.s JOIN cum b ON b.doc_id = k.doc_id AND b.i = k.e
  JOIN (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS w,
               length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS lead FROM chosen) d ON d.doc_id = k.doc_id) k"""


SENTENCES = r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')"


@query("chunk_sentences", packed_sql(SENTENCES, 512, 20))
def chunk_sentences(t):
    return chunk.chunk_sentences(docs(t), 512, 20)


@query("chunk_paragraphs", chunk_cte(64, 8, """
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no
  FROM documents""").replace("SELECT doc_id, i::int", "SELECT doc_id, para_no, i::int") + """
SELECT doc_id, para_no::int AS para_no, (row_number() OVER (PARTITION BY doc_id ORDER BY para_no, chunk_no) - 1)::int AS chunk_no, text,
       (start_char + begin)::int AS start_char, (start_char + begin + length(text))::int AS end_char, n_words
FROM chunks JOIN (
  SELECT doc_id, para_no, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no FROM documents)
) USING (doc_id, para_no)""")
def chunk_paragraphs(t):
    return chunk.chunk_paragraphs(docs(t), "\n", 64, 8)


# Paragraphs are lines here, so what separates them is white space and the words are those of the text.
@query("paragraph_runs", packed_sql("replace(text, chr(10), chr(1))", 64, 8))
def paragraph_runs(t):
    return chunk.chunk_paragraph_runs(docs(t), "\n", 64, 8)


# A simple tokenizer with a fixed pattern: four letters or digits at most, or any other character.
TOKEN = "[A-Za-z0-9]{1,4}"


@query("chunk_tokens", chunk_cte(64, 8).replace(r"'\S+\s*'", rf"'(?:{TOKEN}|\S)\s*'") + CHUNK_ROWS)
def chunk_tokens(t):
    return chunk.chunk_words(docs(t), 64, 8, unit=pattern_unit(TOKEN))


@query("paragraph_lineage", chunk_cte(64, 8, """
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no
  FROM documents""").replace("SELECT doc_id, i::int", "SELECT doc_id, para_no, i::int") + """
SELECT doc_id, sha256(doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY para_no, chunk_no) - 1)) AS node_id, text, true AS in_place
FROM chunks""")
def paragraph_lineage(t):
    nodes = chunk.with_lineage(chunk.chunk_paragraphs(docs(t).withColumn("body", F.col("text")), "\n", 64, 8))
    there = F.substring("body", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")
    return nodes.select("doc_id", "node_id", "text", there.alias("in_place"))


@query("chunk_lineage", chunk_cte(512, 20) + """
SELECT sha256(doc_id || '#' || chunk_no) AS node_id, doc_id::varchar AS ref_doc_id, chunk_no, start_char,
       (start_char + length(text))::int AS end_char, sha256(text) AS doc_hash FROM chunks""")
def chunk_lineage(t):
    nodes = chunk.with_lineage(chunk.chunk_words(docs(t)))
    return collections.with_doc_hash(nodes).select(
        "node_id", "ref_doc_id", "chunk_no", "start_char", "end_char", "doc_hash")


@query("chunk_udtf", chunk_cte(512, 20) + "SELECT doc_id, chunk_no, text AS chunk FROM chunks")
def chunk_udtf(t):
    session = sqljobs.table_session(t.spark, {"documents": t.path("documents")})
    sqljobs.register_chunk_function(session)
    return sqljobs.run_sql(
        session, "SELECT d.doc_id, c.chunk_no, c.chunk FROM documents d, LATERAL chunk_words(d.text, 512, 20) c")


# Fixed values, written out here as the twin must not take them from the code it checks: character references and elements
# that end a line.
REFERENCES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "\'\'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…",
              "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "laquo": "«", "raquo": "»", "amp": "&"}
LINE_ENDS = ("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
             "section table tbody td tfoot th thead title tr ul").replace(" ", "|")
ENTITY_SQL = reduce(lambda s, name: f"replace({s}, '&{name};', '{REFERENCES[name]}')", REFERENCES, "{body}")


def html_sql(heading_steps=""):
    """Text lines of a page: cut the body at tags, then trim and keep the lines that are not empty."""
    cleaned = "html"
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
                    r"(?is)<head\b.*?</head\s*>"):
        cleaned = f"regexp_replace({cleaned}, '{pattern}', '', 'g')"
    body = f"replace({cleaned}, chr(10), ' ')"
    if heading_steps:
        body = rf"regexp_replace({body}, '(?i)<h1\b[^>]*>', chr(10) || '# ', 'g')"
        body = rf"regexp_replace({body}, '(?i)<h2\b[^>]*>', chr(10) || '## ', 'g')"
        body = rf"regexp_replace({body}, '(?i)<li\b[^>]*>', chr(10) || '- ', 'g')"
    body = rf"regexp_replace({body}, '(?i)</?(?:{LINE_ENDS})\b[^>]*>', chr(10), 'g')"
    body = ENTITY_SQL.format(body=f"regexp_replace({body}, '<[^>]*>', '', 'g')")
    lines = "list_transform(string_split(" + body + r", chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g')))"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


@query("html_to_text", f"SELECT page_id, {html_sql()} AS text FROM pages")
def html_to_text(t):
    return spread(t.pages.select("page_id", "html")).select(
        "page_id", text_functions.html_to_text(F.col("html")).alias("text"))


@query("markdown_sections", f"""
WITH md AS (SELECT page_id, {html_sql("headings")} AS body FROM pages),
lines AS (SELECT page_id, unnest(string_split(body, chr(10))) AS line,
                 generate_subscripts(string_split(body, chr(10)), 1) AS n FROM md),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN 1 ELSE 0 END)
                       OVER (PARTITION BY page_id ORDER BY n) AS s FROM lines),
sections AS (SELECT page_id, s, string_agg(line, chr(10) ORDER BY n) AS text, arg_min(line, n) AS first FROM numbered GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY s) - 1)::int AS section_no,
       length(regexp_extract(first, '^(#+) ', 1))::int AS level, regexp_extract(first, '^#+ +(.*)$', 1) AS heading, text
FROM sections""")
def markdown_sections(t):
    pages = spread(t.pages.select("page_id", "html")).select(
        "page_id", text_functions.html_to_markdown(F.col("html")).alias("text"))
    return chunk.split_markdown(pages).select("page_id", "section_no", "level", "heading", "text")


HASH_CTE = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents),
counts AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL)
"""


@query("hash_embedding", HASH_CTE + """
SELECT doc_id, bucket, n FROM counts""")
def hash_embedding(t):
    vectors = embed_hashed(docs(t)).select("doc_id", F.posexplode_outer("embedding").alias("bucket", "n"))
    return vectors.filter(F.col("n") > 0).select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))


def hashing_model():
    """A stand-in for a model: the hash embedding, computed in Python."""
    import hashlib

    def encode(texts):
        vectors = []
        for value in texts:
            counts = [0.0] * 64
            for word in (value or "").lower().split():
                counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
            vectors.append(counts)
        return vectors

    return encode


@query("model_embedding", HASH_CTE + "SELECT doc_id, bucket, n FROM counts")
def model_embedding(t):
    vectors = embed_with(docs(t), hashing_model, batch=64).select("doc_id", F.posexplode_outer("embedding").alias("bucket", "n"))
    return vectors.filter(F.col("n") > 0).select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))


@query("l2_normalise", """
SELECT vec_id, p - 1 AS pos, round(v[p] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x
FROM (SELECT vec_id, embedding::double[] AS v, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)""")
def l2_normalised(t):
    unit = t.embeddings.select("vec_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("pos", "x"))
    return unit.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def label_questions(t):
    """The mean vector of every label asks for the vectors nearest to it."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    return t.embeddings.groupBy("label").agg(mean.alias("embedding"))


def vector_hits(t, k, metric):
    hits = top_k(label_questions(t), t.embeddings, k, metric, query_id="label", node_id="vec_id")
    return hits.select(F.col("query_id").alias("label"), F.col("rank").cast("bigint").alias("rank"),
                       F.col("node_id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_cte(score, order="DESC", k=2):
    return f"""
WITH parts AS (SELECT label, p, avg(embedding[p]::double) AS x
               FROM (SELECT label, embedding, unnest(range(1, 65)) AS p FROM embeddings) GROUP BY ALL),
q AS (SELECT label, list(x ORDER BY p) AS a FROM parts GROUP BY label),
scored AS (SELECT q.label, e.vec_id, {score} AS s FROM q, (SELECT vec_id, embedding::double[] AS b FROM embeddings) e),
hits AS (SELECT label, rank, vec_id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 12) {order}, vec_id) AS rank FROM scored) WHERE rank <= {k})
"""


COSINE = "list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))"


@query("topk_cosine", vector_cte(COSINE) + "FROM hits")
def topk_cosine(t):
    return vector_hits(t, 2, "cosine")


@query("topk_l2", vector_cte("list_distance(a, b)", "ASC") + "FROM hits")
def topk_l2(t):
    return vector_hits(t, 2, "l2")


@query("topk_dot", vector_cte("list_inner_product(a, b)") + "FROM hits")
def topk_dot(t):
    return vector_hits(t, 2, "dot")


# So few bytes per batch that every question is one: the nodes are scanned for each, with the same answer.
@query("topk_cells", vector_cte(COSINE) + "FROM hits")
def topk_batches(t):
    hits = top_k(label_questions(t), t.embeddings, 2, "cosine", query_id="label", node_id="vec_id", batch_bytes=600)
    return hits.select(F.col("query_id").alias("label"), F.col("rank").cast("bigint").alias("rank"),
                       F.col("node_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("compact_context", vector_cte(COSINE, k=5) + r"""
, texts AS (SELECT label, rank, text, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY label ORDER BY rank) AS running
            FROM hits JOIN documents ON doc_id = vec_id)
SELECT label, count(*) AS n_hits, max(running)::bigint AS n_words, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
FROM texts WHERE running <= 1000 GROUP BY label""")
def compact_context(t):
    hits = top_k(label_questions(t), t.embeddings, 5, "cosine", query_id="label", node_id="vec_id")
    texts = attach(hits, t.documents, ["text"], "doc_id").withColumnRenamed("query_id", "label")
    return context.compact_context(texts, 1000, "label")


SEARCH_SQL = r"""
{nodes}
words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM nodes),
nv AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS b, count(*) AS n FROM words GROUP BY ALL),
qw AS (SELECT {ask}, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM questions),
qv AS (SELECT {ask}, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS b, count(*) AS n FROM qw GROUP BY ALL),
nn AS (SELECT {key}, sum(n * n) AS s FROM nv GROUP BY ALL),
qn AS (SELECT {ask}, sum(n * n) AS s FROM qv GROUP BY ALL),
dots AS (SELECT {ask}, {key}, sum(qv.n * nv.n) AS d FROM qv JOIN nv USING (b) GROUP BY ALL),
scored AS (SELECT {ask}, {key}, d / (sqrt(qn.s::double) * sqrt(nn.s::double)) AS score
           FROM dots JOIN nn USING ({key}) JOIN qn USING ({ask})),
ranked AS (SELECT {ask}, {key}, score, row_number() OVER (PARTITION BY {ask} ORDER BY round(score, 12) DESC, node_id) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 2)
"""


def kept_documents(t):
    return docs(t).filter(rule_condition(F.col("text"), exclude=PRESETS["posts"]))


def document_nodes(documents):
    return fold(documents, [chunk.chunk_words, chunk.with_lineage, embed_hashed])


KEPT_SQL = """SELECT doc_id, text FROM documents
  WHERE NOT regexp_matches(text, 'https?://[!-~]') AND NOT contains(text, 'RT @') AND NOT regexp_matches(text, '[@#][A-Za-z0-9_]')"""

NODES_SQL = chunk_cte(512, 20, KEPT_SQL) + """,
nodes AS (SELECT doc_id, chunk_no, sha256(doc_id || '#' || chunk_no) AS node_id, text FROM chunks),
questions AS (SELECT item_id, text FROM benchmark),"""


@query("search_documents", SEARCH_SQL.format(nodes=NODES_SQL, key="node_id", ask="item_id") + """
SELECT item_id, rank, doc_id, chunk_no, round(score, 6) AS score FROM hits JOIN nodes USING (node_id)""")
def search_documents(t):
    hits = search(t.benchmark, document_nodes(kept_documents(t)), carry=["doc_id", "chunk_no"])
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_no",
        F.round("score", 6).alias("score"))


# The same search among stored nodes: some documents come with the first run, the others with the second.
@query("search_collection", SEARCH_SQL.format(nodes=NODES_SQL, key="node_id", ask="item_id") + """
SELECT item_id, rank, doc_id::varchar AS doc_id, chunk_no, round(score, 6) AS score FROM hits JOIN nodes USING (node_id)""")
def search_collection(t):
    root, log = work_path(t.spark, "index"), TaskLog(t.spark, work_path(t.spark, "log"))
    kept = kept_documents(t)
    for i, version in enumerate((kept.filter("doc_id % 3 = 0"), kept)):
        run_sync(t.spark, Version(version), root, "notes", log, f"run {i}", cut=lambda d: chunk.with_lineage(chunk.chunk_words(d, 512, 20)), buckets=8)
    hits = search_stored(t.spark, root, "notes", t.benchmark, carry=["doc_id", "chunk_no"])
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_no",
                       F.round("score", 6).alias("score"))


PROMPT_SQL = TURNS_CTE + r"""
, last AS (SELECT session_id, arg_max(text, turn) AS text FROM turns WHERE role = 'user' GROUP BY session_id),
kept AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM turns) WHERE r <= 300),
history AS (SELECT session_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM kept GROUP BY session_id),
nodes AS (SELECT doc_id AS node_id, text FROM documents),
questions AS (SELECT * FROM last),"""


@query("build_prompts", SEARCH_SQL.format(nodes=PROMPT_SQL, key="node_id", ask="session_id") + r"""
, sized AS (SELECT session_id, rank, text, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY session_id ORDER BY rank) AS running
            FROM hits JOIN nodes USING (node_id)),
context AS (SELECT session_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM sized WHERE running <= 400 GROUP BY session_id)
SELECT session_id, 'You answer from the context.' || chr(10) || chr(10) || 'History:' || chr(10) || coalesce(history, '')
  || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || last.text AS prompt
FROM last LEFT JOIN history USING (session_id) LEFT JOIN context USING (session_id)""")
def build_prompts(t):
    chat = turns(t)
    asked = chat.filter(F.col("role") == "user").groupBy("session_id").agg(F.max_by("text", "turn").alias("question"))
    texts = t.documents.select(F.col("doc_id").alias("node_id"), "text")
    hits = search(asked, embed_hashed(spread(texts)), question_id="session_id", question="question")
    found = context.compact_context(attach(hits, texts, ["text"]), 400).withColumnRenamed("query_id", "session_id")
    history = with_line(memory_window(chat, 300))
    return context.build_prompts(asked, history, found, "You answer from the context.")


@query("render_nodes", """
SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || text AS llm_text,
       'lang: ' || lang || chr(10) || chr(10) || text AS embed_text FROM documents""")
def render_nodes(t):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
                        for k in ("lang", "source", "n_chars")])
    return t.documents.select(
        "doc_id", render_node(entries, F.col("text"), ["n_chars"]).alias("llm_text"),
        render_node(entries, F.col("text"), ["n_chars", "source"]).alias("embed_text"))


@query("nodes_with_docs", chunk_cte(256, 20) + """
SELECT c.doc_id, c.chunk_no, c.n_words, d.source, d.lang FROM chunks c JOIN documents d USING (doc_id)""")
def nodes_with_docs(t):
    # A document has only as many nodes as its one row has words for, so no key is hot.
    nodes = chunk.chunk_words(docs(t), 256, 20).select("doc_id", "chunk_no", "n_words")
    return nodes.join(t.documents.select("doc_id", "source", "lang"), "doc_id")


@query("ref_doc_info", chunk_cte(256, 20) + """
SELECT doc_id::varchar AS ref_doc_id, (chunk_no // 1000)::bigint AS part,
       string_agg(sha256(doc_id || '#' || chunk_no), ',' ORDER BY chunk_no) AS node_ids FROM chunks GROUP BY ALL""")
def ref_doc_info(t):
    nodes = chunk.with_lineage(chunk.chunk_words(docs(t), 256, 20))
    return collections.ref_doc_info(nodes).withColumn("node_ids", F.array_join("node_ids", ","))


# The index holds the labelled documents; the low-quality ones have changed since.
@query("changed_docs", """
SELECT d.doc_id, sha256(d.text) AS doc_hash FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NULL OR l.quality = 0""")
def changed_docs(t):
    documents = t.documents.select("doc_id", "text")
    current = collections.with_doc_hash(documents).select("doc_id", "doc_hash")
    labelled = documents.join(t.labels.select("doc_id", "quality"), "doc_id")
    before = F.when(F.col("quality") == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    indexed = collections.with_doc_hash(labelled.withColumn("text", before))
    return collections.changed_docs(current, indexed)


@query("union_sources", """
SELECT 'd' || doc_id AS doc_id, text, lang, NULL::varchar AS content_type, 'documents' AS data_source_id FROM documents
UNION ALL SELECT 'b' || item_id, text, NULL, 'passage', 'benchmark' FROM benchmark""")
def union_sources(t):
    documents = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang",
                                   F.lit("documents").alias("data_source_id"))
    passages = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("doc_id"), "text",
                                  F.lit("passage").alias("content_type"), F.lit("benchmark").alias("data_source_id"))
    return collections.union_sources(documents, passages).select(
        "doc_id", "text", "lang", "content_type", "data_source_id")


@query("collection_counts", "SELECT source, count(*) AS n_nodes FROM documents GROUP BY source")
def collection_counts(t):
    return collections.collection_counts(t.documents, "source")


@query("ingest_funnel", """
SELECT 0 AS stage_no, 'loaded' AS stage, count(*) AS n FROM pages
UNION ALL SELECT 1, 'https', count(*) FROM pages WHERE starts_with(url, 'https://')
UNION ALL SELECT 2, 'filtered', count(*) FROM pages WHERE starts_with(url, 'https://') AND NOT contains(url, '/es/')""")
def ingest_funnel(t):
    return funnel(t.pages, {"loaded": F.lit(True), "https": F.col("url").startswith("https://"),
                            "filtered": ~matches_any(F.col("url"), ["/es/"])})


class TextTable:
    """Documents of a parquet table, ruled on their text."""

    rule_key = "text"

    def __init__(self, path):
        self.path = path

    def documents(self, spark):
        return spread(spark.read.parquet(self.path).select("doc_id", "text"))


@query("ingest_end_to_end", NODES_SQL.rstrip().rsplit("questions AS", 1)[0].rstrip().rstrip(",") + """
SELECT 'notes' AS collection, sha256(doc_id || '#' || chunk_no || '#' || text) AS node_id, doc_id, chunk_no, text, len(regexp_extract_all(text, '\\S+'))::bigint AS n_words,
       'DONE' AS status FROM nodes""")
def ingest_end_to_end(t):
    root, log = work_path(t.spark, "index"), TaskLog(t.spark, work_path(t.spark, "log"))
    source = TextTable(t.path("documents"))
    sink = collection_sink(root, "notes", unique=True)  # document ids are unique, so node ids are
    for run in ("first", "again"):  # a second run adds nothing
        run_ingest(t.spark, source, sink, log, run, exclude=PRESETS["posts"])
    status = log.read().filter((F.col("task_id") == "again") & (F.col("status") != "STARTED")).first()["status"]
    stored = collections.open_collection(t.spark, root, "notes")
    words = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x).cast("bigint")
    return stored.select("collection", "node_id", "doc_id", "chunk_no", "text", words.alias("n_words"),
                         F.lit(status).alias("status"))


# The documents of one source change between two runs; a third run finds nothing to do.
@query("ingest_update", chunk_cte(256, 20) + """
SELECT sha256(doc_id || '#' || chunk_no || '#' || sha256(d.text)) AS node_id, c.doc_id::varchar AS doc_id, chunk_no, c.text
FROM chunks c JOIN documents d USING (doc_id)""")
def ingest_update(t):
    root = work_path(t.spark, "index")

    def cut(changed):
        return chunk.with_lineage(chunk.chunk_words(changed, 256, 20), parts=("chunk_no", "doc_hash"))

    now = docs(t)
    before = t.documents.select("doc_id", F.when(F.col("source") == "src3", F.upper("text")).otherwise(F.col("text")).alias("text"))
    for version in (before, now, now):
        collections.update_collection(version, cut, root, "notes", buckets=8)
    return collections.open_collection(t.spark, root, "notes").select("node_id", "doc_id", "chunk_no", "text")


class Version:
    """Documents as they are at one time, as a source without rules."""

    rule_key = "text"

    def __init__(self, rows):
        self.rows = rows

    def documents(self, spark):
        return self.rows


# Three versions of the documents: one without a source, one with another source changed, and one without a third one;
# the last one comes twice. Then the parts that the runs left are rewritten as one.
@query("ingest_sync", packed_sql(SENTENCES, 512, 20, "source <> 'src7'", "k.doc_id::varchar AS doc_id, k.chunk_no, text") + """
UNION ALL
SELECT 'run ' || n, 0, CASE n WHEN 1 THEN b - x5 || ' added, 0 changed, 0 removed' WHEN 2 THEN x5 || ' added, ' || x3 || ' changed, 0 removed'
                              WHEN 3 THEN '0 added, 0 changed, ' || x7 || ' removed' ELSE '0 added, 0 changed, 0 removed' END
FROM range(1, 5) r(n), (SELECT count(*) AS b, count(*) FILTER (source = 'src5') AS x5,
                               count(*) FILTER (source = 'src3' AND upper(text) <> text) AS x3, count(*) FILTER (source = 'src7') AS x7 FROM documents)""")
def ingest_sync(t):
    root, log = work_path(t.spark, "index"), TaskLog(t.spark, work_path(t.spark, "log"))
    kept = {c: F.col("source") != c for c in ("src5", "src7")}
    given = spread(t.documents.select("doc_id", "source", "text"))
    shouted = F.when(F.col("source") == "src3", F.upper("text")).otherwise(F.col("text"))
    versions = [given.filter(kept["src5"]).withColumn("text", shouted), given, given.filter(kept["src7"]), given.filter(kept["src7"])]
    runs = []
    for i, version in enumerate(versions):
        counts = run_sync(t.spark, Version(version.drop("source")), root, "notes", log, f"run {i + 1}", buckets=8)
        runs.append((f"run {i + 1}", 0, ", ".join(f"{n} {kind}" for kind, n in counts.items())))
    collections.compact_collection(t.spark, root, "notes", many=1)
    stored = collections.open_collection(t.spark, root, "notes").select("doc_id", "chunk_no", "text")
    return stored.union(t.spark.createDataFrame(runs, "doc_id string, chunk_no int, text string"))


@query("fold_steps", chunk_cte(256, 20, "SELECT doc_id, lower(text) AS text FROM documents") + """
SELECT doc_id, chunk_no, text, n_words FROM chunks WHERE n_words >= 100""")
def fold_steps(t):
    return fold(docs(t), [
        lambda d: d.withColumn("text", F.lower("text")), lambda d: chunk.chunk_words(d, 256, 20),
        lambda d: d.filter(F.col("n_words") >= 100).select("doc_id", "chunk_no", "text", "n_words")])


RUN_SQL = """
SELECT c.c_mktsegment AS segment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey
GROUP BY c.c_mktsegment"""


@query("run_sql", RUN_SQL)
def run_sql(t):
    tables = {name: t.path(name) for name in ("customer", "orders")}
    return sqljobs.run_sql(sqljobs.table_session(t.spark, tables, {"customer", "orders"}), RUN_SQL)


@query("run_sql_with_arguments", """
SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'""")
def run_sql_with_arguments(t):
    session = sqljobs.table_session(t.spark, {name: t.path(name) for name in ("customer", "orders")})
    return sqljobs.run_sql(session, """
        SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey
        WHERE c.c_mktsegment = :segment AND o.o_orderstatus = :status""", {"segment": "BUILDING", "status": "F"})


@query("allowed_tables", """
SELECT 'given' AS question, count(*) AS n FROM customer UNION ALL SELECT 'defined', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'not given', NULL UNION ALL SELECT 'file', NULL UNION ALL SELECT 'command', NULL""")
def allowed_tables(t):
    session = sqljobs.table_session(t.spark, {name: t.path(name) for name in ("customer", "orders")}, {"customer"})
    asked = {"given": "SELECT count(*) AS n FROM customer",
             "defined": "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT count(*) AS n FROM f",
             "not given": "SELECT count(*) AS n FROM nation", "file": f"SELECT count(*) AS n FROM parquet.`{t.path('nation')}`",
             "command": "DROP VIEW customer"}
    answers = [(name, sqljobs.run_sql(session, sql)) for name, sql in asked.items()]
    none = t.spark.range(1).select(F.lit(None).cast("bigint").alias("n"))
    return reduce(lambda a, b: a.union(b), [
        (none if found is None else found).select(F.lit(name).alias("question"), "n") for name, found in answers])


@query("describe_tables", """
SELECT table_name, (row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) - 1)::int AS column_no, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                      WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type
FROM information_schema.columns WHERE table_name IN ('customer', 'documents', 'embeddings', 'lineitem')""")
def describe_tables(t):
    names = ("customer", "documents", "embeddings", "lineitem")
    return sqljobs.describe_tables(sqljobs.table_session(t.spark, {name: t.path(name) for name in names}))
