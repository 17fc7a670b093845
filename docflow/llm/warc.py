"""WARC archives: written as one gzip stream, normalised to a member per record, read back by offset."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import tabled
from docflow.operators.joins import skew_join
from docflow.session import durable, work_path

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Pages of one payload that meet in a task.
HOT_PAGES = 20_000
# Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
INDEX = "archive string, record long, offset long, length long, type string, uri string"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "content binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: the payload as a response, or a revisit that names the response it equals."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    head, _, rest = content.partition(END)
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record begins with {version[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[:int(headers["content-length"])]


class Inflated:
    """A whole gzip file read once as one stream, in pieces: of one member or of many behind each other."""

    def __init__(self, source):
        self.source, self.held, self.left = source, bytearray(), b""
        self.inflate = zlib.decompressobj(31)
        self.ended = False

    def more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.left = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            raw = self.left or self.inflate.unconsumed_tail or self.source.read(CHUNK)
            self.left = b""
            if not raw:
                self.ended = True
                if self.inflate.eof is False and self.started:
                    raise EOFError("the gzip stream breaks off")
                return False
            self.started = True
            out = self.inflate.decompress(raw, CHUNK)
            if self.inflate.eof and not self.inflate.unused_data:
                self.left, self.inflate, self.started = b"", zlib.decompressobj(31), False
            self.held += out
            if out:
                return True
        return False

    started = False

    def records(self) -> Iterator[bytes]:
        """Whole records, one at a time; what surrounds them is dropped."""
        while True:
            at = self.held.find(END)
            while at < 0:
                if not self.more():
                    if self.held.strip():
                        raise EOFError("the last record breaks off")
                    return
                at = self.held.find(END, max(0, at))
            start = 0
            while start < len(self.held) and self.held[start] in b"\r\n":
                start += 1
            if start:
                del self.held[:start]
                continue
            length = next(int(x.split(b":", 1)[1]) for x in bytes(self.held[:at]).split(b"\r\n")
                          if x.lower().startswith(b"content-length:"))
            end = at + len(END) + length
            while len(self.held) < end:
                if not self.more():
                    raise EOFError("a record breaks off")
            yield bytes(self.held[:end]) + END
            del self.held[:end]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it: local, HDFS or an object store, by the address."""
    return fs.FileSystem.from_uri(uri)


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add `refers_to`: null on the row that stands for its payload, which is that of the largest page id.

    Digests are grouped first, without their payloads; those that come once
    need no partner, and frequent ones are joined in pieces of `HOT_PAGES` rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"_sha": F.sha1("payload"), "_n": F.length("payload")})
    rows = rows.withColumn("_g", F.concat_ws("-", "_sha", "_n"))
    groups = tabled(rows.filter(F.col("_n") >= least_bytes).groupBy("_g").agg(F.max("page_id").alias("_largest"), F.count("*").alias("_rows")).filter(
        "_rows > 1"), "payloads")
    hot = groups.filter(F.col("_rows") > HOT_PAGES).select("_g", F.ceil(F.col("_rows") / HOT_PAGES).alias("_cuts"))
    joined = skew_join(rows, groups.select("_g", "_largest"), "_g", "left", hot=hot)
    other = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("_largest")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write each task's records as archives of one gzip stream each; returns their addresses.

    Every attempt of a task writes under names of its own, and only those of
    the attempt that counted are returned, so lost executors leave no trace.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    address = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, path = _place(address)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, size, pack = system.open_output_stream(path, compression=None), 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                content = record(row["page_id"], row["url"], row["payload"], row["refers_to"], date)
                out.write(pack.compress(content))
                size += len(content)
                if size >= ARCHIVE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    yield pa.record_batch([pa.array([address])], names=["archive"])
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.record_batch([pa.array([address])], names=["archive"])

    return durable(rows.mapInArrow(write, "archive string"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with every record as a gzip member of its own, and write its offset index beside it.

    Takes a column `archive` of addresses of gzip files, of one stream or many
    members. Each file is inflated once, in pieces, with one record in memory.
    Returns per file `archive`, `normalised`, `index` (JSON lines: archive,
    record, offset, length, type, uri), `records` and `error`, which is null or
    says where a broken file ends; the records before that are there.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                yield _rewrite(address, f"{folder}/{uuid.uuid4().hex}")

    files = max(1, archives.count())
    return durable(archives.select("archive").repartition(files).mapInArrow(
        rewrite, "archive string, normalised string, index string, records long, error string"))


def _rewrite(address: str, name: str) -> pa.RecordBatch:
    system, source = _place(address)
    target, path = _place(f"{name}.warc.gz")
    target.create_dir(path.rpartition("/")[0], recursive=True)
    offset, n, error = 0, 0, None
    index_path = path.removesuffix(".warc.gz") + ".json"
    with (system.open_input_stream(source, compression=None) as stream, target.open_output_stream(path, compression=None) as out,
          target.open_output_stream(index_path, compression=None) as index):
        try:
            for content in Inflated(stream).records():
                headers, _ = parse(content)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(content) + pack.flush()
                out.write(member)
                index.write(json.dumps({"archive": f"{name}.warc.gz", "record": n, "offset": offset, "length": len(member),
                                        "type": headers.get("warc-type"), "uri": headers.get("warc-target-uri")}).encode() + b"\n")
                offset, n = offset + len(member), n + 1
        except (EOFError, ValueError, KeyError, StopIteration, zlib.error) as broken:
            error = f"record {n}: {type(broken).__name__}: {broken}"
    return pa.record_batch([[address], [f"{name}.warc.gz"], [f"{name}.json"], pa.array([n], pa.int64()), pa.array([error], pa.string())],
                           names=["archive", "normalised", "index", "records", "error"])


def read_index(written: DataFrame) -> DataFrame:
    """The index rows of the archives that `normalise` returned, and of no other file that lies beside them.

    Fails if an archive broke off, or if its index is not as long as told.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, address, records, error in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if error is not None:
                    raise ValueError(f"{archive} broke off: {error}")
                system, path = _place(address)
                rows, n = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for line in io.TextIOWrapper(io.BufferedReader(stream), "utf-8", newline="\n"):
                        rows.append(json.loads(line))
                        n += 1
                        if len(rows) >= 10_000:
                            yield _index(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{address} has {n} rows for {records} records")
                yield _index(rows)

    return written.select("archive", "index", "records", "error").mapInArrow(read, INDEX)


def _index(rows: list[dict]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in INDEX.split(", ")]
    return pa.record_batch([pa.array([r[f] for r in rows], types[t]) for f, t in fields], names=[f for f, _ in fields])


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that index rows point to, each by its own offset and length.

    A response's digest and length are those of the payload read; a revisit's
    are what its headers tell of the payload it leaves out.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            rows = []
            for address, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if address not in files:
                    for old in files.values():
                        old.close()
                    system, path = _place(address)
                    files = {address: system.open_input_file(path)}
                files[address].seek(offset)
                rows.append(_row(zlib.decompress(files[address].read(length), 31)))
                if sum(len(r[-1] or b"") for r in rows[-1:]) > CHUNK or len(rows) >= 500:
                    yield _records(rows)
                    rows = []
            yield _records(rows)

    return index.select("archive", "offset", "length").mapInArrow(read, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in RECORD.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _row(content: bytes) -> tuple:
    from urllib.parse import unquote

    headers, block = parse(content)
    http, _, payload = block.partition(END)
    number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind, told = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        payload = None
    else:
        size = len(payload)
        if digest(payload) != told:
            raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
    return number("warc-record-id"), headers.get("warc-target-uri"), size, told, kind, number("warc-refers-to"), payload


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pages as normalised archives below `folder`: what was written, and the records read back.

    Takes `page_id`, `url` and `html`; a null html is an empty payload, a null
    page id or url is left out of the record. Of rows with one payload of at
    least `least_bytes`, those with the largest page id are responses and the
    others revisits of it; without any page id all are responses. An empty
    table gives no archive and no record. An archive that breaks off fails the
    read.
    """
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(2 * spark.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))
    rows = with_responses(pages, least_bytes).coalesce(archives)
    written = normalise(write_archives(rows, f"{folder}/streams"), f"{folder}/records")
    return written, read_records(read_index(written))


@query("op2_warc_round_trip")
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = archive_pages(table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
