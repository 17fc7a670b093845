import base64
import gzip
import hashlib
import json
import os
from collections import Counter

import pytest

from docflow.llm.warc import archive_pages, normalise, parse, read_index, record


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for page_id, payload in payloads:
        if page_id is not None:
            largest[payload] = max(largest.get(payload, page_id), page_id)
    out = []
    for page_id, payload in payloads:
        first = largest.get(payload)
        same = page_id == first
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if same else "revisit", None if same else first))
    return Counter(out)


def test_round_trip(spark, folder):
    rows = [(1, "http://a/ü?x=1 2", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://b\r\nX: y", None), (8, "u", ""),
            (None, "n", "<p>é</p>"), (9, "big", "WARC/1.1\r\n\r\n" * 200_000), (9, "big", "other"), (9, "big", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 archive", "'x' payload", "2 refers_to")
    written, records = archive_pages(pages.repartition(3), folder)
    got = records.collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert {r.page_id: r.content for r in got if r.record_type == "response"}[9] in (b"other", rows[5][2].encode())
    assert all(r.error is None for r in written.collect())
    for row in written.collect():
        with open(row.normalised, "rb") as file:
            content = file.read()
        with open(row["index"]) as lines:
            index = [json.loads(x) for x in lines]
        assert gzip.decompress(content) == gzip.decompress(open(row.archive, "rb").read())
        assert sum(x["length"] for x in index) == len(content) and len(index) == row.records
        for x in index:
            headers, _ = parse(gzip.decompress(content[x["offset"]:x["offset"] + x["length"]]))
            assert headers["warc-type"] == x["type"]


def test_empty_table(spark, folder):
    written, records = archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert written.count() == 0 and records.count() == 0


@pytest.mark.parametrize("cut", [1, 30, 200])
def test_broken_streams_keep_what_is_whole(spark, folder, cut):
    content = b"".join(record(i, "u", b"x" * 50, None, "d") for i in range(3))
    path = f"{folder}/broken.warc.gz"
    with open(path, "wb") as out:
        out.write(gzip.compress(content[:-cut]))
    row = normalise(spark.createDataFrame([(path,)], "archive string"), f"{folder}/out").first()
    assert row.records in (1, 2, 3) and (row.error or row.records == 3)
    whole = f"{folder}/members.warc.gz"
    with open(whole, "wb") as out:
        out.write(b"".join(gzip.compress(record(i, None, b"", None, "d")) for i in range(4)))
    row = normalise(spark.createDataFrame([(whole,)], "archive string"), f"{folder}/out").first()
    assert (row.records, row.error) == (4, None)


def test_files_of_lost_tasks_are_not_read(spark, folder):
    rows = [(i, "u", f"page {i}") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    lost, _ = archive_pages(pages, folder)
    os.makedirs(f"{folder}/records", exist_ok=True)
    with open(f"{folder}/records/torn.json", "w") as out:
        out.write('{"archive": "' + lost.first().normalised + '", "record": 0, "off')
    _, records = archive_pages(pages, folder)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()) == expected(rows)


def test_an_archive_that_breaks_off_fails_the_read(spark, folder):
    path = f"{folder}/broken.warc.gz"
    with open(path, "wb") as out:
        out.write(gzip.compress(b"".join(record(i, "u", b"x" * 50, None, "d") for i in range(3))[:-30]))
    written = normalise(spark.createDataFrame([(path,)], "archive string"), f"{folder}/out")
    with pytest.raises(Exception, match="broke off"):
        read_index(written).collect()


def test_query(spark):
    from docflow.llm.queries import QUERIES

    got = QUERIES["op2_warc_round_trip"](spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in got) == expected(rows)
