import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.functions.vectors import hash_embedding
from docflow.operators import chunk, collections, joins, metadata, quality
from docflow.plans import sqljobs
from docflow.plans.embedding import embed, embed_hashed
from docflow.plans.ingest import collection_sink, cut_nodes, funnel, run_ingest
from docflow.plans.search import attach, search
from docflow.plans.tasks import TaskLog, task_status
from docflow.schema import DOCUMENT
from docflow.session import durable, shared_dir, size_shuffles, spread, work_path
from docflow.sources.documents import as_documents
from docflow.sources.files import extract_text
from docflow.streaming.ingest import landed_files, stream_ingest, stream_update

DOCS = [(1, "alpha beta gamma"), (2, "mail me @bob"), (3, "delta epsilon")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


class Fixture:
    rule_key = "text"

    def documents(self, spark):
        return docs(spark)


class Broken(Fixture):
    def documents(self, spark):
        return docs(spark).withColumn("text", F.raise_error(F.lit("landing folder is gone")))


def test_ingest_job_is_logged_and_repeatable(spark, folder):
    log = TaskLog(spark, f"{folder}/log")
    for task in ("t1", "t2"):
        run_ingest(spark, Fixture(), collection_sink(f"{folder}/index", "notes"), log, task, exclude=["@[a-z]+"])
    stored = collections.open_collection(spark, f"{folder}/index", "notes")
    assert sorted(r.ref_doc_id for r in stored.collect()) == ["1", "3"]
    t1 = log.read().filter("task_id = 't1'")
    assert [(r.status, r.stage, r.rows) for r in t1.orderBy("at", F.desc("rows"), F.desc("stage")).collect()] == [
        ("STARTED", None, None), ("STARTED", "loaded", 3), ("STARTED", "nodes", 2), ("STARTED", "filtered", 2),
        ("DONE", None, None)]
    assert {r.task_id: r.status for r in task_status(log.read()).collect()} == {"t1": "DONE", "t2": "DONE"}


def test_only_new_nodes_are_embedded_and_a_changed_text_is_one(spark, folder):
    def write(rows):
        embedded = spark.sparkContext.accumulator(0)

        def load():
            def model(texts):
                embedded.add(len(texts))
                return [[1.0]] * len(texts)
            return model

        collections.write_collection(cut_nodes(docs(spark, rows)), folder, "c", embed=lambda n: embed(n, load))
        return embedded.value

    assert write(DOCS) == 3
    assert write(DOCS) == 0
    assert write([*DOCS[:2], (3, "changed"), (4, "new")]) == 2
    assert collections.open_collection(spark, folder, "c").count() == 5


def test_a_failed_job_is_logged_and_raised(spark, folder):
    log = TaskLog(spark, f"{folder}/log")
    with pytest.raises(Exception, match="landing folder is gone"):
        run_ingest(spark, Broken(), collection_sink(f"{folder}/index", "notes"), log, "t", exclude=["x"])
    last = task_status(log.read()).first()
    assert last.status == "ERROR"
    assert "landing folder" in log.read().filter("status = 'ERROR'").first().error


def test_collections(spark, folder):
    root = f"{folder}/index"
    nodes = embed_hashed(cut_nodes(docs(spark)))
    with pytest.raises(collections.CollectionError):
        collections.open_collection(spark, root, "a")
    assert collections.open_collection(spark, root, "a", "create", nodes.schema).isEmpty()
    collections.write_collection(nodes, root, "a")
    collections.write_collection(nodes.filter("doc_id < 2"), root, "b")
    collections.write_collection(nodes, root, "b")
    collections.write_collection(nodes, root, "a")
    counts = collections.collection_counts(spark.read.parquet(root))
    assert {r.collection: r.n_nodes for r in counts.collect()} == {"a": 3, "b": 3}
    with pytest.raises(collections.CollectionError):
        collections.open_collection(spark, root, "c")
    assert collections.open_collection(spark, root, "c", "create").isEmpty()
    assert collections.open_collection(spark, root, "a").count() == 3


def test_persisted_index(spark, folder):
    collections.persist_index(chunk.with_lineage(chunk.chunk_words(docs(spark), 2, 0)), f"{folder}/i")
    info = {r.ref_doc_id: r.node_ids for r in spark.read.parquet(f"{folder}/i/ref_doc_info").collect()}
    nodes = spark.read.parquet(f"{folder}/i/nodes").orderBy("chunk_no").collect()
    assert info["1"] == [r.node_id for r in nodes if r.ref_doc_id == "1"] and len(info["1"]) == 2


def test_changed_documents(spark):
    indexed = collections.with_doc_hash(docs(spark))
    now = collections.with_doc_hash(docs(spark, [(1, "alpha beta gamma"), (3, "changed"), (4, "new")]))
    assert sorted(r.doc_id for r in collections.changed_docs(now, indexed).collect()) == [3, 4]


def test_union_fills_what_a_source_lacks(spark):
    both = collections.union_sources(docs(spark), spark.sql("SELECT 9L AS doc_id, 'x' AS text, 'de' AS lang"))
    assert {r.doc_id: r.lang for r in both.collect()} == {1: None, 2: None, 3: None, 9: "de"}


def test_documents_have_one_shape(spark):
    plain = spark.sql("SELECT 'a/b.TXT' AS file_path, 'hi' AS text, 3 AS stars, CAST(NULL AS STRING) AS lang")
    issue = spark.sql("SELECT 'APP-1' AS issue_key, 'body' AS text, 'bug' AS issue_type")
    both = collections.union_sources(
        as_documents(plain, "drive", ["file_path"]), as_documents(issue, "tracker", ["issue_key"]))
    assert both.schema.simpleString() == DOCUMENT.simpleString()
    rows = {r.data_source_id: r for r in both.collect()}
    assert rows["drive"].metadata == {"stars": "3"} and rows["drive"].file_path == "a/b.TXT"
    assert rows["tracker"].metadata == {"issue_key": "APP-1", "issue_type": "bug"}
    assert rows["drive"].doc_id == as_documents(plain, "drive", ["file_path"]).first().doc_id != rows["tracker"].doc_id


def test_funnel_counts_nested_stages(spark):
    rows = funnel(docs(spark), {"loaded": F.lit(True), "odd": F.col("doc_id") % 2 == 1, "null": F.lit(None).cast("boolean")})
    assert [(r.stage, r.n) for r in rows.orderBy("stage_no").collect()] == [("loaded", 3), ("odd", 2), ("null", 0)]


def test_model_embedding_loads_once_per_task_and_batches(spark):
    def load():
        sizes = []

        def model(texts):
            sizes.append(len(texts))
            return [[float(len(t)), float(len(sizes)), float(sizes[-1])] for t in texts]
        return model

    rows = embed(docs(spark, [(i, "x" * i) for i in range(5)]).coalesce(1), load, batch=2).orderBy("doc_id").collect()
    assert [r.embedding for r in rows] == [[0, 1, 2], [1, 1, 2], [2, 2, 2], [3, 2, 2], [4, 3, 1]]


def test_hash_embedding_counts_words(spark):
    a, b, c = (r.v for r in docs(spark, [(1, "Cat cat dog"), (2, "dog CAT\ncat"), (3, "")]).select(
        "doc_id", hash_embedding(F.col("text"), 16).alias("v")).orderBy("doc_id").collect())
    assert a == b and sum(a) == 3 and max(a) >= 2 and c == [0.0] * 16
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(hash_embedding(F.col("t"), 4)).first()[0] == [0.0] * 4


def test_search_takes_any_embedding(spark):
    def lengths(df):
        return df.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))

    nodes = lengths(docs(spark, [(1, "a"), (2, "bbbb"), (3, "c" * 9)])).withColumnRenamed("doc_id", "node_id")
    asked = spark.createDataFrame([("q", "dddd")], "item_id string, text string")
    hits = search(asked, nodes, 2, "l2", embed=lengths)
    assert [(r.query_id, r["rank"], r.node_id) for r in hits.orderBy("rank").collect()] == [("q", 1, 2), ("q", 2, 1)]
    assert [r.text for r in attach(hits, nodes, ["text"]).orderBy("rank").collect()] == ["bbbb", "a"]


# --- SQL over library tables -------------------------------------------------

BOOKS = [(1, "Animal Farm", "George Orwell", "i1", 1945, "Satire"), (2, "1984", "George Orwell", "i2", 1949, "Dystopian"),
         (3, "The Martian", "Andy Weir", "i3", 2011, "Science Fiction"), (4, "Dune", "Frank Herbert", "i3", 1965, "Science Fiction"),
         (5, "Lost", None, None, 2020, None)]
INVENTORY = [(1, 3, "available"), (2, 3, "checked_out"), (3, 4, "reserved"), (4, 2, "available"), (5, 77, "available")]


@pytest.fixture
def library(spark, folder):
    books = spark.createDataFrame(BOOKS, "book_id int, title string, author string, isbn string, publication_year int, genre string")
    inventory = spark.createDataFrame(INVENTORY, "inventory_id int, book_id int, status string")
    books.write.parquet(f"{folder}/books")
    inventory.write.parquet(f"{folder}/inventory")
    return {"books": f"{folder}/books", "inventory": f"{folder}/inventory"}


def answers(session, sql, **args):
    return sorted(map(tuple, sqljobs.run_sql(session, sql, args).collect()))


def test_library_questions(spark, library):
    session = sqljobs.table_session(spark, library, {"books", "inventory"})
    assert answers(session, "SELECT book_id, title FROM books WHERE author = :author", author="George Orwell") == [
        (1, "Animal Farm"), (2, "1984")]
    assert answers(session, "SELECT book_id FROM books WHERE publication_year = :year", year=2020) == [(5,)]
    assert answers(session, "SELECT b.book_id, b.title, count(*) n FROM books b JOIN inventory i ON b.book_id = i.book_id "
                            "WHERE b.genre = :genre AND i.status = 'available' GROUP BY ALL", genre="Science Fiction") == [
        (3, "The Martian", 1)]
    assert answers(session, "SELECT book_id FROM books WHERE author IS NULL") == [(5,)]
    assert answers(session, "SELECT * FROM (SELECT book_id, status FROM inventory) "
                            "PIVOT (count(*) FOR status IN ('available', 'checked_out'))") == [
        (2, 1, None), (3, 1, 1), (4, None, None), (77, 1, None)]
    assert answers(session, "SELECT b.book_id FROM books b LEFT ANTI JOIN inventory i ON b.book_id = i.book_id") == [(1,), (5,)]


def test_failed_sql_gives_nothing(spark, library):
    session = sqljobs.table_session(spark, library)
    assert sqljobs.run_sql(session, "SELECT nonsense FROM books") is None
    assert sqljobs.run_sql(session, "SELEC 1") is None


def test_only_given_tables_are_seen(spark, library, folder):
    spark.range(1).createOrReplaceTempView("secret")
    session = sqljobs.table_session(spark, {"books": library["books"]})
    assert sqljobs.run_sql(session, "SELECT * FROM books").count() == 5
    assert sqljobs.run_sql(session, "SELECT * FROM secret") is None
    assert sqljobs.run_sql(session, "SELECT * FROM inventory") is None
    assert sqljobs.run_sql(session, f"SELECT * FROM parquet.`{library['inventory']}`") is None


def test_only_queries_run(spark, library, folder):
    session = sqljobs.table_session(spark, library)
    for text in ["DROP VIEW books", "SET spark.sql.ansi.enabled=false", f"INSERT OVERWRITE DIRECTORY '{folder}/x' USING parquet SELECT 1",
                 "SELECT 1) t; DROP VIEW books --"]:
        assert sqljobs.run_sql(session, text) is None
    for text in ["SELECT java_method('java.lang.System', 'getProperty', 'user.name') x", "SELECT reflect('java.util.UUID', 'randomUUID') x FROM books",
                 "SELECT (SELECT max(try_reflect('java.lang.System', 'getProperty', title)) FROM books) x",
                 "SELECT raise_error('no') x FROM books", "SELECT CAST(title AS INT) x FROM books", "SELECT * FROM other.db.table",
                 "SELECT * FROM books WHERE book_id IN (SELECT v FROM global_temp.secret)"]:
        spark.range(1).toDF("v").createOrReplaceGlobalTempView("secret")
        assert sqljobs.run_sql(session, text) is None, text
    assert answers(session, "WITH b AS (SELECT book_id FROM books) SELECT min(book_id) m FROM b; ") == [(1,)]
    assert answers(session, "SELECT 'SubqueryAlias spark_catalog.x' AS a -- note") == [("SubqueryAlias spark_catalog.x",)]
    ordered = sqljobs.run_sql(session, "SELECT book_id FROM books ORDER BY book_id DESC LIMIT 2")
    assert [r.book_id for r in ordered.collect()] == [5, 4]


def test_catalog_tables_are_not_given(spark, library, folder):
    spark.sql(f"CREATE TABLE hidden USING parquet LOCATION '{library['books']}'")
    try:
        session = sqljobs.table_session(spark, library)
        for name in ("hidden", "default.hidden", "spark_catalog.default.hidden"):
            assert sqljobs.run_sql(session, f"SELECT * FROM {name}") is None
            assert sqljobs.run_sql(session, f"SELECT (SELECT count(*) FROM {name}) AS n FROM books") is None
    finally:
        spark.sql("DROP TABLE hidden")


def test_required_tables(spark, library):
    with pytest.raises(sqljobs.MissingTables, match="inventory"):
        sqljobs.table_session(spark, {"books": library["books"]}, {"books", "inventory"})
    session = sqljobs.table_session(spark, {"books": library["books"]})
    assert sqljobs.missing_tables(session, {"books", "inventory"}) == {"inventory"}


def test_described_tables(spark, library):
    rows = sqljobs.describe_tables(sqljobs.table_session(spark, library)).collect()
    assert ("inventory", 2, "status", "string") in [tuple(r) for r in rows] and len(rows) == 9


def test_result_shapes(spark):
    one = spark.sql("SELECT 1 AS a")
    assert [r.result for r in metadata.shape_result(one).collect()] == ["1"]
    assert [r.result for r in metadata.shape_result(one.filter("a > 1")).collect()] == ["No results found"]
    two = spark.sql("SELECT * FROM VALUES (1, 'x'), (2, NULL) t(a, b)")
    assert [r.result for r in metadata.shape_result(two).collect()] == ['{"a":1,"b":"x"}', '{"a":2,"b":null}']
    assert metadata.positional(two).columns == ["Col0", "Col1"]


def test_constraints(spark, library):
    books, inventory = (spark.read.parquet(library[n]) for n in ("books", "inventory"))
    report = quality.constraint_report([
        ("isbn", "unique", books, ["isbn"]), ("author", "not_null", books, "author"),
        ("book", "reference", inventory, "book_id", books, "book_id"), ("id", "unique", books, ["book_id"])])
    assert {r.check_name: r.violations for r in report.collect()} == {"isbn": 1, "author": 1, "book": 1, "id": 0}


def test_sql_chunk_function(spark, library):
    session = sqljobs.table_session(spark, library)
    sqljobs.register_chunk_function(session)
    rows = answers(session, "SELECT book_id, c.* FROM books, LATERAL chunk_words(title, 1, 0) c WHERE book_id IN (1, 2)")
    assert rows == [(1, 0, "Animal"), (1, 1, "Farm"), (2, 0, "1984")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_a_hot_key(spark, how):
    many = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 500) AS k", "map('a', id) AS m")
    one = spark.range(0, 400).selectExpr("id AS k", "id * 10 AS v")
    assert [(r.k, r._cuts) for r in joins.hot_keys(many, "k", 100).collect()] == [(7, 11)] and joins.hot_keys(many, "k").count() == 0
    salted = sorted((r.id, r.v) for r in joins.skew_join(many, one, "k", how, hot_rows=100).collect())
    assert salted == sorted(((r.id, r.v) for r in many.join(one, "k", how).collect()))


def test_durable_frames_use_the_session_folder(spark):
    folder = shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert work_path(spark, "x").startswith(folder)
    assert durable(spark.range(5)).count() == 5


def test_shuffles_grow_with_the_data(spark):
    session = spark.newSession()
    assert size_shuffles(session, 10) == int(session.conf.get("spark.sql.shuffle.partitions"))
    assert size_shuffles(session, 100 << 40) == 400 * 1024
    assert session.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == str(400 * 1024)


def test_spread_moves_small_scans_only(spark, folder):
    spark.range(0, 100, 1, 20).write.parquet(f"{folder}/many")
    spark.range(0, 100, 1, 1).write.parquet(f"{folder}/one")
    cores = spark.sparkContext.defaultParallelism
    one, many = spread(spark.read.parquet(f"{folder}/one")), spark.read.parquet(f"{folder}/many")
    assert one.rdd.getNumPartitions() == cores and one.count() == 100
    assert spread(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20
    assert spread(many).count() == 100


def test_landed_files_are_ingested_once(spark, folder, tmp_path):
    landing = tmp_path / "landing" / "sub"
    landing.mkdir(parents=True)
    (landing / "a.txt").write_text("alpha beta")

    def nodes(batch):
        return cut_nodes(extract_text(batch).withColumn("doc_id", F.sha2("file_path", 256)))

    def run(checkpoint):
        stream_ingest(landed_files(spark, str(tmp_path / "landing"), "*.txt"), nodes, f"{folder}/index", "c",
                      f"{folder}/{checkpoint}").awaitTermination()
        return sorted(r.text for r in collections.open_collection(spark, f"{folder}/index", "c").collect())

    assert run("c1") == ["alpha beta"]
    (landing / "b.txt").write_text("gamma")
    assert run("c1") == ["alpha beta", "gamma"]
    assert run("c2") == ["alpha beta", "gamma"]


def test_a_stream_takes_so_many_files_at_a_time(spark, folder, tmp_path):
    landing, sizes = tmp_path / "landing", []
    landing.mkdir()
    for i in range(5):
        (landing / f"{i}.txt").write_text(f"text {i}")

    def run(files):
        files.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option(
            "checkpointLocation", f"{folder}/c{len(sizes)}").trigger(availableNow=True).start().awaitTermination()

    run(landed_files(spark, str(landing), most=2))
    assert sizes == [2, 2, 1]
    run(landed_files(spark, str(landing)))
    assert sizes == [2, 2, 1, 5]


def test_a_stream_batch_is_opened_once(spark, folder, tmp_path):
    """Files of a batch that are gone after they were read do not fail it, and no copy of them stays."""
    landing, checkpoint = tmp_path / "landing", f"{folder}/check"
    landing.mkdir()
    for i in range(3):
        (landing / f"{i}.txt").write_text(f"text {i}")

    def to_docs(batch):
        for path in landing.iterdir():
            path.unlink()
        return extract_text(batch).withColumn("doc_id", F.col("file_name"))

    before = {p.name for p in Path(re.sub("^file:", "", shared_dir(spark))).glob("batch-*")}
    stream_update(landed_files(spark, str(landing), "*.txt"), to_docs, cut_nodes, f"{folder}/index", "c", checkpoint).awaitTermination()
    assert sorted(r.text for r in collections.open_collection(spark, f"{folder}/index", "c").collect()) == ["text 0", "text 1", "text 2"]
    assert {p.name for p in Path(re.sub("^file:", "", shared_dir(spark))).glob("batch-*")} == before


def test_a_changed_document_replaces_its_nodes(spark, folder):
    root, cuts = f"{folder}/c", []

    def cut(changed):
        cuts.append(sorted(r.doc_id for r in changed.collect()))
        return chunk.with_lineage(chunk.chunk_words(changed, 2, 0), parts=("chunk_no", "doc_hash"))

    def update(**texts):
        frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        collections.update_collection(frame, cut, root, "n")
        return sorted(r.text for r in collections.open_collection(spark, root, "n").collect())

    assert update(a="one two three", b="four") == ["four", "one two", "three"]
    assert update(a="new words", b="four", c="more") == ["four", "more", "new words"]
    assert update(a="new words") == ["four", "more", "new words"]
    assert update(a="one two three") == ["four", "more", "one two", "three"]
    assert update(b="", c="more") == ["more", "one two", "three"]
    assert cuts == [["a", "b"], ["a", "c"], ["a"], ["b"]]


def test_hash_embedding_counts_in_one_pass(spark):
    """Whatever the number of buckets: no pass over the words for each of them."""
    texts = ["", None, "one", "One one two, three", "a b c " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for dim in (1, 3, 64):
        found = docs.select("i", "text", hash_embedding(F.col("text"), dim).alias("v"))
        assert "array_remove" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {r.i: r.v for r in found.collect()}
        assert [len(got[i]) for i in range(5)] == [dim] * 5
        assert [sum(got[i]) for i in range(5)] == [0, 0, 1, 4, 150]
        assert all(n >= 0 and n == int(n) for v in got.values() for n in v)
        assert max(got[3]) >= 2 and sorted(got[4])[-1] >= 50
