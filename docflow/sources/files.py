"""Folder and vault scans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.functions import paths
from docflow.functions.text import decode_text, has_text, html_to_text, strict_utf8
from docflow.operators.quality import good
from docflow.operators.rules import SUPPORTED_EXTENSIONS
from docflow.session import task_files, work_path
from docflow.sources.office import READERS, parse_files


Readers = dict[str, Callable[[bytes], str]]
#: Files that a scan is given by name; more are read by tasks, so many files and bytes at a time.
NAMED_FILES, TASK_FILES, READ_BYTES = 20_000, 1_000, 8 << 20
FILE = "file_path string, file_name string, file_extension string, last_modified timestamp, file_size long, content binary"


def scan_files(spark: SparkSession, root: str | list[str], glob: str | None = None) -> DataFrame:
    """One row per file below `root`. Leave out `content` and the bytes are never read.

    The glob is tested while listing. Names that begin with `_` or `.` are not listed by Spark.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = paths.file_name(F.col("path"))
    return reader.load(root).select(
        F.col("path").alias("file_path"), name.alias("file_name"), paths.splitext(name).alias("file_extension"),
        F.col("modificationTime").alias("last_modified"), F.col("length").alias("file_size"), "content")


def extension_glob(extensions: list[str]) -> str:
    """A glob for names with one of the extensions, in any case."""
    def letters(extension):
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)

    return "{" + ",".join(f"*.{letters(e)}" for e in extensions) + "}"


def _opened(path: str, known: dict) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, whatever characters it has; `known` holds those opened before."""
    scheme, root, rest = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(//[^/]*)?(/.*)", path, re.S).groups()
    start = f"{scheme}:{root}/" if scheme and scheme != "file" else "/"
    if start not in known:
        known[start] = task_files(start)
    system, place = known[start]
    return system, place.rstrip("/") + rest


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's scans leave out."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark names files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def list_files(spark: SparkSession, root: str | list[str], path: str | None = None) -> DataFrame:
    """The rows of `scan_files` without `content`, for folders with more files than a driver should list.

    Tasks list a folder each, level by level, and write what they find to `path`,
    a new one in the shared folder if not given; a row is the same as in a scan.
    `root` is no glob, but may be several folders and files.
    """
    tops = [qualified(spark, top) for top in ([root] if isinstance(root, str) else root)]
    path, schema = path or work_path(spark, "listed"), "path string, folder boolean, modified timestamp, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, place = _opened(folder, known)
                own = system.get_file_info(place)
                if own.is_file:
                    found, above = [own], folder.rpartition("/")[0]
                else:
                    found, above = [i for i in system.get_file_info(fs.FileSelector(place)) if not _hidden(i.base_name, not i.is_file)], folder.rstrip("/")
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    yield pa.record_batch([
                        pa.array([f"{above}/{i.base_name}" for i in part]), pa.array([i.type == fs.FileType.Directory for i in part]),
                        pa.array([i.mtime_ns and i.mtime_ns // 1_000_000 * 1000 for i in part], pa.timestamp("us", "UTC")),
                        pa.array([i.size for i in part], pa.int64())], names=["path", "folder", "modified", "length"])

    folders, level = spark.createDataFrame([(top,) for top in tops], "path string"), 0
    while True:
        folders.mapInArrow(run, schema).write.parquet(f"{path}/level={level}")
        folders = spark.read.schema(schema).parquet(f"{path}/level={level}").filter("folder").select("path")
        count = folders.count()
        if not count:
            break
        folders, level = folders.repartition(min(count, 4 * spark.sparkContext.defaultParallelism)), level + 1
    name = paths.file_name(F.col("path"))
    return spark.read.schema(schema).parquet(*[f"{path}/level={i}" for i in range(level + 1)]).filter("not folder").select(
        F.col("path").alias("file_path"), name.alias("file_name"), paths.splitext(name).alias("file_extension"),
        F.col("modified").alias("last_modified"), F.col("length").alias("file_size"))


def read_paths(spark: SparkSession, listed: DataFrame, named: int = NAMED_FILES) -> DataFrame:
    """The files named by `file_path`, with their content.

    A scan is told the files it reads, so their names pass through the driver,
    `named` of them at most. If there are more, tasks read the files that their
    rows name, each once, and write them to the shared folder.
    """
    listed = listed.select("file_path").distinct()
    count = listed.count()
    if count <= named:
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["file_path"]) for r in listed.collect()]
        return scan_files(spark, names) if names else spark.createDataFrame([], FILE)

    tasks = max(2 * spark.sparkContext.defaultParallelism, count // TASK_FILES)
    path = work_path(spark, "files")
    with_contents(listed.repartition(tasks, "file_path")).write.parquet(path)
    return spark.read.schema(FILE).parquet(path)


def with_contents(listed: DataFrame) -> DataFrame:
    """The files named by the first column with their content, as `scan_files` has them; tasks open those that their rows name.

    `listed` may be a stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, size = {}, [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path, known)
                with system.open_input_stream(place) as file:
                    content = file.read()
                rows.append((path, system.get_file_info(place).mtime_ns // 1_000_000 * 1000, len(content), content))
                size += len(content) + 100
                if size >= READ_BYTES:
                    yield _file_rows(rows)
                    rows, size = [], 0
        if rows:
            yield _file_rows(rows)

    read = listed.mapInArrow(run, "file_path string, last_modified timestamp, file_size long, content binary")
    name = paths.file_name(F.col("file_path"))
    return read.select("file_path", name.alias("file_name"), paths.splitext(name).alias("file_extension"), "last_modified", "file_size", "content")


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file_path", "last_modified", "file_size", "content"])


def read_files(spark: SparkSession, root: str, extensions: list[str] = SUPPORTED_EXTENSIONS,
               condition: Column | None = None, named: int = NAMED_FILES) -> DataFrame:
    """Files with an allowed extension that also meet `condition` on their metadata.

    A scan reads the content of every file it lists before a filter sees the
    row. So the metadata is filtered first, and only the kept files are read,
    by `read_paths`.
    """
    files = scan_files(spark, root, extension_glob(extensions)).filter(F.col("file_extension").isin(*extensions))
    return files if condition is None else read_paths(spark, files.filter(condition).select("file_path"), named)


def vault_results(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes with `text`, and `_error` for a file that is not UTF-8."""
    notes = scan_files(spark, root, "*.[mM][dD]").withColumn("file_extension", F.lower("file_extension"))
    return with_error(notes.withColumn("text", strict_utf8(F.col("content"))).drop("content"), "not UTF-8")


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """The good rows of `vault_results`."""
    return good(vault_results(spark, root))


def with_error(docs: DataFrame, why: str) -> DataFrame:
    """Add `_error` to rows without a text, unless they have one already."""
    known = F.col("_error") if "_error" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("_error", F.coalesce(known, F.when(F.col("text").isNull(), why)))


def extract_results(files: DataFrame, readers: Readers | None = None) -> DataFrame:
    """Text by extension: office parts, HTML, otherwise strict UTF-8; `_error` says why a file has none.

    `readers` adds functions from bytes to text for more extensions; without
    one for it, a PDF file has no text. Only files with a reader leave the JVM.
    """
    readers = {**READERS, **(readers or {})}
    parsed = F.col("file_extension").isin(*readers)
    plain = strict_utf8(F.col("content"))
    text = (F.when(F.col("file_extension") == "html", html_to_text(plain))
            .when(F.col("file_extension") != "pdf", plain))
    unread = F.when(F.col("file_extension") == "pdf", "no reader for pdf").cast("string")
    docs = files.filter(~parsed).withColumns({"text": text, "_error": unread}).drop("content")
    return with_error(docs, "not UTF-8").unionByName(parse_files(files.filter(parsed), readers))


def extract_text(files: DataFrame, drop_blank: bool = True, readers: Readers | None = None) -> DataFrame:
    """The good rows of `extract_results`, blank texts only if asked for."""
    docs = good(extract_results(files, readers))
    return docs.filter(has_text(F.col("text"))) if drop_blank else docs


def decode_results(files: DataFrame, readers: Readers | None = None) -> DataFrame:
    """UTF-8 whatever the extension, then a reader's text, then Latin-1 for text files; `_error` for other files.

    Readers know docx and xlsx and what `readers` adds. A blank text of theirs
    is an error; decoded text is kept as it is.
    """
    readers = {"docx": READERS["docx"], "xlsx": READERS["xlsx"], **(readers or {})}
    decoded = files.withColumn("text", decode_text(F.col("content"), F.col("file_extension")))
    parsed = F.coalesce(F.col("file_extension").isin(*readers), F.lit(False)) & F.col("text").isNull()
    read = parse_files(decoded.filter(parsed).drop("text"), readers)
    read = read.withColumn("_error", F.when(F.col("_error").isNull() & ~has_text(F.col("text")), "blank").otherwise(F.col("_error")))
    return with_error(decoded.filter(~parsed).drop("content"), "not UTF-8, no reader").unionByName(read)


def decode_cascade(files: DataFrame, readers: Readers | None = None) -> DataFrame:
    """The good rows of `decode_results`."""
    return good(decode_results(files, readers))
