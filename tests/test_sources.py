import io
import json
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.functions.records import render_node, zset_members
from docflow.functions.text import html_to_text
from docflow.operators import chunk, collections, metadata, quality
from docflow.plans.sync import sync_folder
from docflow.schema import KV
from docflow.sources import files, listings, records, tables
from docflow.sources.office import DRAWING, LINK, PACKAGE, SHEET, SLIDE, WORD

LATIN = "caf\xe9".encode("latin-1")


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return buffer.getvalue()


def space(name):
    return name.strip("{}")


def parts(main, items, targets):
    """A main part that lists others, and the links that say where they are."""
    folder, name = main.rsplit("/", 1)
    listed = "".join(f'<{items} r:id="r{i}"/>' for i in range(len(targets)))
    links = "".join(f'<Relationship Id="r{i}" Target="{target}"/>' for i, target in enumerate(targets))
    return {main: f'<m xmlns="{space(SLIDE if items == "sldId" else SHEET)}" xmlns:r="{space(LINK)}">{listed}</m>',
            f"{folder}/_rels/{name}.rels": f'<Relationships xmlns="{space(PACKAGE)}">{links}</Relationships>'}


DOCX = zipped({"word/document.xml": f'<w:document xmlns:w="{space(WORD)}"><w:body>'
               "<w:p><w:r><w:t>one</w:t></w:r><w:hyperlink><w:r><w:tab/><w:t>two</w:t></w:r></w:hyperlink></w:p><w:p/>"
               "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
               "<w:p><w:r><w:t>üç</w:t></w:r></w:p></w:body></w:document>"})
SHAPE = "<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p><a:r><a:t>mo</a:t></a:r><a:fld><a:t>re</a:t></a:fld></a:p></p:txBody></p:sp>"
SLIDE_XML = (f'<p:sld xmlns:p="{space(SLIDE)}" xmlns:a="{space(DRAWING)}"><p:cSld><p:spTree>{SHAPE}'
             "<p:grpSp>" + SHAPE.format(t="grouped") + "</p:grpSp></p:spTree></p:cSld></p:sld>")
PPTX = zipped({f"ppt/slides/slide{n}.xml": SLIDE_XML.format(t=f"title {n}") for n in (1, 2)}
              | parts("ppt/presentation.xml", "sldId", ["slides/slide2.xml", "/ppt/slides/slide1.xml"]))
XLSX = zipped({
    "xl/sharedStrings.xml": f'<sst xmlns="{space(SHEET)}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space(SHEET)}"><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>7</v></c></row>'
                                '<row r="3"><c t="s"><v>1</v></c><c/><c t="inlineStr"><is><t>in</t></is></c><c><v>0</v></c>'
                                '<c><v>1.50</v></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c><f>A1+1</f><v>8</v></c></row>'
                                "</sheetData></worksheet>"} | parts("xl/workbook.xml", "sheet", ["worksheets/sheet1.xml"]))
XLSX_TEXT = "name 7\n\nab in 1.5 True =A1+1\n"
HTML = ("<!DOCTYPE html><html><head><title>T</title></head><body>\n <h1>Hello &amp; hi</h1>\n <p>A  <b>bold</b>\n line.</p>"
        "<ul>\n<li>one</li>\n<li>two</li></ul><script>x<y</script><!-- no --></body></html>")


@pytest.fixture
def tree(tmp_path):
    for name, content in {
        "a.txt": b"plain", "sub/b.HTML": HTML.encode(), "sub/c.docx": DOCX, "sub/deep/d.pptx": PPTX, "e.exe": b"x",
        "blank.txt": b" \n\t", "bad.txt": LATIN, ".txt": b"hidden", "broken.docx": b"not a zip",
        "v/note.md": b"# N", "v/loud.MD": b"up", "v/bad.md": LATIN,
    }.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "tree")


def test_folder_scan_and_dispatch(spark, tree):
    found = files.read_files(spark, tree)
    assert sorted(r.file_name for r in found.select("file_name").collect()) == [
        "a.txt", "b.HTML", "bad.txt", "blank.txt", "broken.docx", "c.docx", "d.pptx"]
    docs = {r.file_name: r for r in files.extract_text(found).collect()}
    assert {n: r.text for n, r in docs.items()} == {
        "a.txt": "plain", "b.HTML": "Hello & hi\nA bold line.\none\ntwo", "c.docx": "one\ttwo\n\nüç",
        "d.pptx": "title 2\nmore\ntitle 1\nmore"}
    assert docs["a.txt"].file_size == 5 and isinstance(docs["a.txt"].last_modified, datetime)
    kept_blank = files.extract_text(found, drop_blank=False)
    assert sorted(r.file_name for r in kept_blank.select("file_name").collect()) == [
        "a.txt", "b.HTML", "blank.txt", "c.docx", "d.pptx"]
    outcomes = {r.file_name: r._error for r in files.extract_results(found).collect()}
    assert len(outcomes) == found.count() and outcomes["bad.txt"] == "not UTF-8" and "BadZipFile" in outcomes["broken.docx"]
    assert [n for n, e in outcomes.items() if e] == [n for n in outcomes if n in ("bad.txt", "broken.docx")]


def test_content_is_read_of_kept_files_only(spark, tree, tmp_path):
    (tmp_path / "tree" / "odd [1]{2}.txt").write_bytes(b"odd")
    (tmp_path / "tree" / "odd 1.txt").write_bytes(b"no")
    outside = ~F.col("file_path").contains("/sub/") & (F.col("file_name") != "odd 1.txt")
    for most in (files.NAMED_FILES, 2):
        kept = files.read_files(spark, tree, condition=outside, named=most)
        assert sorted((r.file_name, bytes(r.content)) for r in kept.collect()) == [
            ("a.txt", b"plain"), ("bad.txt", LATIN), ("blank.txt", b" \n\t"), ("broken.docx", b"not a zip"),
            ("odd [1]{2}.txt", b"odd")]
    assert len(files.read_files(spark, tree, condition=outside).inputFiles()) == 5
    assert files.read_files(spark, tree, condition=F.lit(False)).count() == 0
    plan = files.scan_files(spark, tree).select("file_path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_vault_scan(spark, tree):
    assert {r.file_name: (r.text, r.file_extension) for r in files.read_vault(spark, tree).collect()} == {
        "note.md": ("# N", "md"), "loud.MD": ("up", "md")}


def test_decode_cascade(spark):
    rows = [("a.x", "x", b"text"), ("bom.txt", "txt", b"\xef\xbb\xbfhello"), ("l.txt", "txt", LATIN), ("l.bin", "bin", LATIN),
            ("w.docx", "docx", DOCX), ("s.xlsx", "xlsx", XLSX), ("p.pptx", "pptx", PPTX), ("bad.docx", "docx", b"\xff\xfe"),
            ("real.pdf", "pdf", b"utf-8 anyway"), ("blank.txt", "txt", b" ")]
    df = spark.createDataFrame([(n, e, bytearray(c)) for n, e, c in rows],
                               "file_name string, file_extension string, content binary")
    assert {r.file_name: r.text for r in files.decode_cascade(df).collect()} == {
        "a.x": "text", "bom.txt": "hello", "l.txt": "café", "w.docx": "one\ttwo\n\nüç", "s.xlsx": XLSX_TEXT,
        "real.pdf": "utf-8 anyway", "blank.txt": " "}


def test_more_readers_can_be_given(spark):
    rows = [("a.pdf", "pdf", b"%PDF-1.4 \xff"), ("b.pdf", "pdf", b"%PDF plain"), ("c.txt", "txt", b"c"), ("d.docx", "docx", DOCX)]
    df = spark.createDataFrame([(n, e, bytearray(c)) for n, e, c in rows],
                               "file_name string, file_extension string, content binary")

    def pdf(content):
        return f"{len(content)} bytes" if content.endswith(b"\xff") else 1 / 0

    assert {r.file_name for r in files.extract_text(df).collect()} == {"c.txt", "d.docx"}
    assert {r.file_name: r.text for r in files.extract_text(df, readers={"pdf": pdf}).collect()} == {
        "a.pdf": "10 bytes", "c.txt": "c", "d.docx": "one\ttwo\n\nüç"}
    assert {r.file_name: r.text for r in files.decode_cascade(df, {"pdf": pdf}).collect()} == {
        "a.pdf": "10 bytes", "b.pdf": "%PDF plain", "c.txt": "c", "d.docx": "one\ttwo\n\nüç"}


def test_html_lines(spark):
    page = spark.createDataFrame([("<html><head><title>x</title></head><body><h1>Tide times</h1><p>High at six, löw at noon.</p>"
                                   "<ul><li>north pier</li><li>south&nbsp;pier</li></ul></body></html>",)], "h string")
    assert page.select(html_to_text(F.col("h"))).first()[0] == "Tide times\nHigh at six, löw at noon.\nnorth pier\nsouth pier"


@pytest.mark.parametrize("html, text", [
    ("it&#8217;s &#x1F600;", "it’s 😀"), ("&#0;&#xD800;&#9999999;&#;&#12 &#x;", "&#0;&#xD800;&#9999999;&#;&#12 &#x;"),
    ("&amp;#39; &amp;lt; &lt;b&gt;", "&#39; &lt; <b>"), ("a&#160;b&nbsp;c", "a b c"), ("&unknown;&copy;", "&unknown;©"),
    ("<!-- <p>no</p> --><style>p{}</style>a<br/>b<DIV class='x'>c</DIV>d", "a\nb\nc\nd"), ("", "")])
def test_html_characters(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h"))).first()[0] == text


def blobs(spark, contents):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


def test_repository_tree(spark):
    tree = spark.createDataFrame(
        [("blob", "a/x.py", "x.py", "2024-05-01T10:00:00Z"), ("tree", "a", "a", None), ("blob", "b.PNG", "b.PNG", ""),
         ("blob", "gone", "gone", "")], "type string, path string, name string, committed_date string")
    content = blobs(spark, {"a/x.py": b"print()", "b.PNG": LATIN})
    docs = listings.from_repo_tree(tree, content).collect()
    assert [(d.file_path, d.file_extension, d.text, d.last_modified) for d in docs] == [
        ("a/x.py", "py", "print()", datetime(2024, 5, 1, 10))]
    entries = tree.filter("type = 'blob'").select(F.col("path").alias("file_path"))
    found = listings.with_content(entries, content)
    assert sorted((r.file_path, r._error) for r in found.collect()) == [("a/x.py", None), ("b.PNG", None), ("gone", "content missing")]
    results = listings.repo_tree_results(tree, content)
    assert {r.file_path: r._error for r in results.collect()} == {"a/x.py": None, "b.PNG": "not UTF-8", "gone": "content missing"}


def test_drive_listing_over_all_pages(spark, tmp_path):
    for page, entries in enumerate([[("file", "/a.txt"), ("folder", "/d")], [("file", "/d/b.docx"), ("file", "/c.bin")]]):
        (tmp_path / f"page{page}.json").write_text("\n".join(json.dumps(
            {"tag": tag, "path_display": p, "name": p.rsplit("/", 1)[1], "client_modified": "2024-05-01T10:00:00"})
            for tag, p in entries))
    listing = spark.read.json(str(tmp_path))
    docs = listings.from_drive_listing(listing, blobs(spark, {"/a.txt": LATIN, "/d/b.docx": DOCX, "/c.bin": LATIN}))
    assert {d.file_path: d.text for d in docs.collect()} == {"/a.txt": "café", "/d/b.docx": "one\ttwo\n\nüç"}


def test_flat_drive_items(spark):
    items = spark.createDataFrame(
        [("a.md", ("text",), "u", "2024-05-01T10:00:00Z"), ("dir", None, "u", ""), ("b.md", ("text",), None, ""),
         ("c.md", ("text",), "u", "")],
        "name string, file struct<mimeType:string>, download_url string, lastModifiedDateTime string")
    docs = listings.from_graph_items(items, blobs(spark, {"a.md": b"hi", "b.md": b"no", "c.md": LATIN, "dir": b""}))
    assert [(d.file_path, d.text) for d in docs.collect()] == [("a.md", "hi")]


def test_issue(spark):
    issues = spark.createDataFrame([json.dumps({"key": "APP-1", "fields": {
        "summary": "S", "description": None, "issuetype": {"name": "Bug"}, "status": {"name": "Open"}, "created": "c",
        "updated": "u", "assignee": None, "reporter": {"displayName": "R"}}})], "string")
    shape = ("key string, fields struct<summary:string,description:string,issuetype:struct<name:string>,"
             "status:struct<name:string>,created:string,updated:string,assignee:struct<displayName:string>,"
             "reporter:struct<displayName:string>>")
    row = records.from_issues(issues.select(F.from_json("value", shape).alias("i")).select("i.*"), "tracker").first()
    assert row.text == ("Issue Key: APP-1\nSummary: S\nDescription: None\nIssue Type: Bug\nStatus: Open\n"
                        "Created: c\nUpdated: u")
    assert (row.issue_type, row.assignee, row.reporter) == ("bug", None, "R")


def test_posts(spark):
    posts = spark.createDataFrame(
        [("1", "2024-01-01", "me", "mine", None, 0, 0), ("2", "2024-01-02", "me", "cut…", ("bob", "hi"), 1, 2),
         ("3", "2023-01-01", "me", "old", None, 0, 0), ("4", "2020-01-01", "you", "other", None, 0, 0)],
        "post_id string, created_at string, user string, text string, original struct<user:string,text:string>, "
        "retweet_count long, favorite_count long")
    assert {r.post_id: (r.text, r.content_type) for r in records.from_posts(posts, "p", 2).collect()} == {
        "1": ("mine", "tweet"), "2": ("RT @bob: hi", "retweet"), "4": ("other", "tweet")}


def test_key_value_documents(spark):
    rows = [
        ("garden:7:bed", "hash", None, {"soil": "wet", "name": "Ö"}, None, None, None),
        ("kiln:batch:9", "string", "half fired", None, None, None, 300),
        ("route:4:stops", "list", None, None, ["b", "a"], None, -1), ("labels/seen", "set", None, None, ["y", "x", "y"], None, 0),
        ("regatta", "zset", None, None, None, [("oak", 61.0), ("elm", 48.5), ("ash", 12.0)], None),
        ("s:1", "stream", None, None, None, None, None)]
    docs = {r.file_path: r for r in records.from_kv(spark.createDataFrame(rows, KV), "kv").collect()}
    assert {k: d.text for k, d in docs.items()} == {
        "garden:7:bed": '{"name":"Ö","soil":"wet"}', "kiln:batch:9": "half fired",
        "route:4:stops": '["b","a"]', "labels/seen": '["x","y"]', "regatta": '["ash","elm","oak"]'}
    assert docs["kiln:batch:9"].expiry == "300" and docs["regatta"].expiry == "no_expiry"
    assert docs["labels/seen"].file_name == "seen"


def test_equal_scores_go_by_member(spark):
    row = spark.sql("SELECT array(named_struct('member','b','score',1D), named_struct('member','a','score',1D)) z")
    assert row.select(zset_members(F.col("z"))).first()[0] == ["a", "b"]


def test_rendered_node(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
                        for k, v in [("page_label", "1"), ("file_name", "a.pdf"), ("file_path", "p/a.pdf")]])
    one = spark.range(1)
    assert one.select(render_node(entries, F.lit("T"), ["file_name"])).first()[0] == "page_label: 1\nfile_path: p/a.pdf\n\nT"
    assert one.select(render_node(entries, F.lit("T"))).first()[0] == "page_label: 1\nfile_path: p/a.pdf\n\nT"
    assert one.select(render_node(entries, F.lit("T"), [])).first()[0].count("\n") == 4


def test_metadata_steps(spark):
    df = spark.sql("SELECT map('Type', 'BUG', 'a', 'X') AS metadata, 'f.Txt' AS file_name")
    assert metadata.lower_key(df, "Type").first().metadata == {"Type": "bug", "a": "X"}
    assert metadata.prune_metadata(df, ["a", "zz"]).first().metadata == {"a": "X"}
    row = metadata.with_source(df, "id", "parse").first()
    assert (row.data_source_id, row.file_type, row.processing_method) == ("id", "txt", "parse")


def test_quarantine_and_expiry(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": '), (3, None), (4, '{"k": "x"}')], "id int, props string")
    good, bad = quality.quarantine(quality.parse_json(df, "props", spark.sql("SELECT 1L AS k").schema))
    assert [(r.id, r.parsed.k) for r in good.collect()] == [(1, 1)]
    assert {r.id: r._error for r in bad.collect()} == {2: "malformed", 3: "missing", 4: "malformed"}
    keys = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 10L), "
                     "('b', TIMESTAMP '2024-01-01 00:00:00', 11L), ('c', TIMESTAMP '2000-01-01 00:00:00', NULL) t(key, written_at, ttl_s)")
    alive = quality.unexpired(keys, datetime(2024, 1, 1, 0, 0, 10))
    assert sorted(r.key for r in alive.collect()) == ["b", "c"]


def test_blank_texts(spark):
    df = spark.createDataFrame([("a",), ("   \n",), ("\x1c\x85",), (None,), ("",), ("​",)], "text string")
    assert [r.text for r in quality.drop_blank(df).collect()] == ["a", "​"]


def test_persisted_index(spark, tmp_path):
    vector = [0.5] * 4
    (tmp_path / "docstore.json").write_text(json.dumps({
        "docstore/ref_doc_info": {"d": {"node_ids": ["n"], "metadata": {}}},
        "docstore/data": {"n": {"__data__": {"id_": "n", "text": "body", "start_char_idx": 0, "end_char_idx": 45,
                                            "metadata": {"page_label": "1", "file_size": 17278}}, "__type__": "1"}},
        "docstore/metadata": {"n": {"doc_hash": "h", "ref_doc_id": "d"}}}))
    (tmp_path / "default__vector_store.json").write_text(json.dumps(
        {"embedding_dict": {"n": vector}, "text_id_to_ref_doc_id": {"n": "d"}, "metadata_dict": {}}))
    (node,) = tables.load_index_json(spark, str(tmp_path)).collect()
    assert (node.node_id, node.ref_doc_id, node.doc_hash, node.text) == ("n", "d", "h", "body")
    assert (node.start_char, node.end_char, node.embedding) == (0, 45, vector)
    assert node.metadata == {"page_label": "1", "file_size": "17278"}


def test_files_are_named_in_batches(spark, folder):
    """More files than one scan is told: each batch is written before the next; odd names are taken literally."""
    names = [f"a{i}.txt" for i in range(5)] + ["b [1].txt", "{c}.txt", "d*.txt", "d1.txt"]
    for name in names:
        (Path(folder) / name).write_text(f"text of {name}")
    listed = files.scan_files(spark, folder)
    for named in (3, 100):
        found = files.read_paths(spark, listed.filter("file_name <> 'd1.txt'").select("file_path"), named)
        assert {r.file_name: bytes(r.content).decode() for r in found.collect()} == {n: f"text of {n}" for n in names if n != "d1.txt"}
    assert files.read_paths(spark, listed.filter("false").select("file_path")).count() == 0


def test_files_are_listed_and_read_by_tasks(spark, folder):
    """What tasks list is what a scan lists, and what they read what it reads; no list of names passes through the driver."""
    for name in ("a.txt", "x/b [1]%20 é.TXT", "x/y/c.txt", "x/_d.txt", "x/.e.txt", "_f/g.txt", "_h=1/i.txt", "x/j", "x/y/k._COPYING_"):
        path = Path(folder) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {name}")
    (Path(folder) / "empty").mkdir()
    scanned, listed = files.scan_files(spark, folder), files.list_files(spark, folder)
    assert sorted(listed.collect()) == sorted(scanned.drop("content").collect())
    assert not any("BinaryFile" in line or "binaryFile" in line for line in listed._jdf.queryExecution().executedPlan().toString().splitlines())
    assert sorted(files.read_paths(spark, listed, 2).collect()) == sorted(scanned.collect())
    assert all("files-" in name for name in files.read_paths(spark, listed, 2).inputFiles())


def test_folder_sync_reads_changed_files_only(spark, folder):
    """A file that changes in place, one that goes, one that cannot be read, and one with another extension."""
    notes, root = Path(folder) / "notes", f"{folder}/index"
    notes.mkdir()
    read = []

    def cut(docs):
        read.append(sorted(r.file_name for r in docs.select("file_name").collect()))
        return chunk.with_lineage(chunk.chunk_words(docs, 2, 0))

    def run(**texts):
        for name, text in texts.items():
            (notes / f"{name}.txt").write_bytes(text)
        return sync_folder(spark, str(notes), root, "n", cut=cut, extensions=["txt"])

    def held():
        return sorted(r.text for r in collections.open_collection(spark, root, "n", "create").collect())

    (notes / "x.bin").write_bytes(b"no")
    assert run(a=b"one two three", b=b"four", c=b"\xff") == {"added": 3, "changed": 0, "removed": 0}
    assert held() == ["four", "one two", "three"]
    assert run() == {"added": 0, "changed": 0, "removed": 0}
    (notes / "b.txt").unlink()
    assert run(a=b"changed", d=b"new") == {"added": 1, "changed": 1, "removed": 1}
    assert held() == ["changed", "new"]
    assert read == [["a.txt", "b.txt"], ["a.txt", "d.txt"]]


def test_contents_are_joined_where_they_lie(spark, folder):
    """Only the listing is shuffled to the buckets of the contents."""
    blobs = spark.createDataFrame([(f"p{i}", f"text {i}".encode()) for i in range(50)], "path string, content binary")
    listings.land_contents(blobs, "landed_contents", 4, f"{folder}/contents")
    entries = spark.createDataFrame([(f"p{i}",) for i in range(0, 60, 2)], "file_path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = listings.with_content(entries, spark.table("landed_contents"), 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE landed_contents")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert {r.file_path: r.content and bytes(r.content).decode() for r in rows} == {f"p{i}": f"text {i}" if i < 50 else None for i in range(0, 60, 2)}
