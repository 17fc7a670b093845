"""An index of the files below a folder, in the order they landed, which streams read instead of the folder.

Spark's stream of files lists them all in its driver and remembers every one.
Here tasks list the folder, compare it with the index and write what is new, in
parts of so many files; the driver names these in their order, and a stream of
the parts remembers parts.

What a run adds is decided when its note in `_runs` is there, which is numbered
and never overwritten: it says which parts get which names. A run that broke
off after that is finished by the next one, and of two runs that began at the
same note the second begins again, so no file is added twice.
"""

from __future__ import annotations

import json
import logging
import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from docflow.operators.store import _files, write_once
from docflow.session import remove_path, shared_dir, task_files, work_path
from docflow.sources.files import list_files, qualified

#: Files of one part of an index. A stream takes whole parts.
PART_FILES = 1_000
PART = "path string, modified timestamp, length long"
#: Seconds between two looks at the folder, at least, while a stream goes on.
LOOK_S = 1.0


@dataclass(frozen=True)
class Landing:
    """`place` holds the index of the files below `root` whose names `glob` matches, in parts of `part_files` at most."""

    root: str
    glob: str
    part_files: int
    place: str

    def known(self) -> bool:
        """If tasks can list and read the folder themselves."""
        try:
            task_files(re.sub(r"[\[\]{}*?\\].*", "", self.root, flags=re.S))
        except (OSError, ValueError, NotImplementedError):
            return False
        return True

    def refresh(self, spark: SparkSession) -> int:
        """Add the files that the index lacks, the oldest first; returns how many."""
        while True:
            try:
                return self._add(spark)
            except FileExistsError:
                continue

    def stream(self, spark: SparkSession, most: int) -> DataFrame:
        """The index as a stream of `PART`, in batches of at most `most` files; it grows while it is followed."""
        _follow_streams(spark, self)
        return (spark.readStream.schema(PART).option("maxFilesPerTrigger", max(1, most // self.part_files))
                .option("maxFileAge", "36500d").parquet(self.place))

    def _tops(self, spark: SparkSession) -> list[str]:
        files, path = _files(spark, self.root)
        if not spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().isGlobPath(path):
            if not files.exists(path):
                raise FileNotFoundError(self.root)
            return [self.root]
        return [status.getPath().toString() for status in files.globStatus(path) or ()]

    def _numbered(self, spark: SparkSession, names: str):
        """What there is below `place` under numbers, in their order."""
        files, path = _files(spark, re.sub(r"([\[\]{}*?\\])", r"\\\1", self.place) + f"/{names}")
        return files.globStatus(path)

    def _add(self, spark: SparkSession) -> int:
        files, notes = _files(spark, f"{self.place}/_runs")
        files.mkdirs(notes)
        run = self._finish(spark) + 1
        held, tops = self._numbered(spark, "[0-9]*.parquet"), self._tops(spark)
        if not tops:
            return 0
        listed, stage, noted = work_path(spark, "listed"), f"_{uuid.uuid4().hex}", False
        files.mkdirs(_files(spark, f"{self.place}/{stage}")[1])
        try:
            # The pattern that Spark's scans test names with, as a regular expression.
            names = spark._jvm.org.apache.hadoop.fs.GlobPattern(self.glob).compiled().pattern()
            found = list_files(spark, tops, listed).filter(F.col("file_name").rlike(f"\\A(?s:{names})\\z")).select(
                F.col("file_path").alias("path"), F.col("last_modified").alias("modified"), F.col("file_size").alias("length"))
            if len(held):  # a small table of names on storage is large in memory, so it is not sent to all tasks
                found = found.join(spark.read.schema(PART).parquet(self.place).select("path").hint("merge"), "path", "left_anti")
            parts = sorted(found.select("path", "modified", "length").repartitionByRange("modified", "path").sortWithinPartitions("modified", "path")
                           .mapInArrow(_part_writer(f"{self.place}/{stage}", self.part_files), "task int, number int, name string, files long").collect())
            if parts:
                last = held[len(held) - 1].getModificationTime() if len(held) else 0
                self._date(spark, [f"{self.place}/{stage}/{part.name}" for part in parts], max(last + 1, int(time.time() * 1000)))
                write_once(spark, f"{self.place}/_runs", f"{run:012d}.json", json.dumps({"stage": stage, "first": len(held) + 1, "parts": [p.name for p in parts]}))
                noted = True
                self._finish(spark)
            return sum(part.files for part in parts)
        finally:
            remove_path(spark, listed)
            if not noted:
                remove_path(spark, f"{self.place}/{stage}")

    def _date(self, spark: SparkSession, parts: list[str], at: int) -> None:
        """Streams take files by their time, so each part gets a later one, from `at` on."""
        for k, part in enumerate(parts):
            files, path = _files(spark, part)
            files.setTimes(path, at + k, -1)
            if not k and files.getFileStatus(path).getModificationTime() != at:
                raise RuntimeError(f"{self.place}: files keep no times there, by which a stream would read them in their order")

    def _finish(self, spark: SparkSession) -> int:
        """Give the parts of the last noted run their names, if they lack them; returns the run's number."""
        notes = self._numbered(spark, "_runs/[0-9]*.json")
        if not len(notes):
            return 0
        files, path = _files(spark, notes[len(notes) - 1].getPath().toString())
        stream = files.open(path)
        try:
            note = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        stage = f"{self.place}/{note['stage']}"
        if files.exists(_files(spark, stage)[1]):
            for number, name in enumerate(note["parts"], note["first"]):
                _move(spark, f"{stage}/{name}", f"{self.place}/{number:012d}.parquet")
            remove_path(spark, stage)
        return len(notes)


def _move(spark: SparkSession, path: str, name: str) -> None:
    """Rename a file if another run has not done so; no process is started for it, as it would be by what checks names."""
    (files, source), target = _files(spark, path), _files(spark, name)[1]
    try:
        if files.exists(source) and not files.rename(source, target):
            raise OSError(f"cannot rename {path}")
    except Exception:  # noqa: BLE001  (the gateway wraps what Java throws)
        if files.exists(source) or not files.exists(target):
            raise


def landing(spark: SparkSession, root: str, glob: str, most: int, index: str | None = None) -> Landing:
    """The index of a folder, by default one in the shared folder that all streams of the same files have in common."""
    top, part_files = qualified(spark, root), min(most, PART_FILES)
    name = sha256(f"{top}\0{glob}\0{part_files}".encode()).hexdigest()[:32]
    return Landing(top, glob, part_files, f"{(index or shared_dir(spark)).rstrip('/')}/landed-{name}")


def _part_writer(stage: str, part_files: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, place), task, number, rest = task_files(stage), TaskContext.get().partitionId(), 0, None

        def put(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            name, number = f"{uuid.uuid4().hex}.parquet", number + 1
            pq.write_table(rows, f"{place}/{name}", filesystem=system)
            return pa.record_batch([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([name]),
                                    pa.array([rows.num_rows], pa.int64())], names=["task", "number", "name", "files"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            while rest.num_rows >= part_files:
                yield put(rest.slice(0, part_files))
                rest = rest.slice(part_files)
        if rest is not None and rest.num_rows:
            yield put(rest)

    return run


# Indexes that streams of this process may read, by place, and the sessions that say when a stream starts.
_LANDINGS: dict[str, Landing] = {}
_WATCHED: set[str] = set()


def _follow_streams(spark: SparkSession, of: Landing) -> None:
    """From now on, a stream of this session that reads the index and goes on keeps it growing until it ends."""
    _LANDINGS[of.place] = of
    session = f"{spark.sparkContext.applicationId} {spark._jsparkSession.sessionUUID()}"
    if session not in _WATCHED:
        _WATCHED.add(session)
        spark.streams.addListener(_Starts(spark))


class _Starts(StreamingQueryListener):
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def onQueryStarted(self, event) -> None:
        threading.Thread(target=_follow, args=(self.spark, str(event.id)), daemon=True).start()

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _follow(spark: SparkSession, query_id: str) -> None:
    query = spark.streams.get(query_id)
    if query is None:
        return
    running = query._jsq.streamingQuery()
    kind = running.trigger().toString()
    if kind.startswith(("AvailableNow", "OneTime")):  # they end with what was there when they began
        return
    plan = running.analyzedPlan().toString()
    followed = [of for place, of in list(_LANDINGS.items()) if place.removeprefix("file://").rsplit("/", 1)[-1] in plan]
    if not followed:
        return
    pause = running.trigger().intervalMs() / 1000 if kind.startswith("ProcessingTime") else 0
    while _active(query):
        began = time.monotonic()
        for of in followed:
            try:
                of.refresh(spark)
            except Exception:  # noqa: BLE001  (the folder may be back next time; the stream has what was found before)
                if _active(query):
                    logging.getLogger(__name__).exception("cannot list %s", of.root)
        took = time.monotonic() - began
        # Triggers come at multiples of their interval, and the next look ends before the next one.
        left = pause - time.time() % pause - 2 * took - LOOK_S if pause else 0
        time.sleep(max(LOOK_S, took, left))


def _active(query) -> bool:
    try:
        return query.isActive
    except Exception:  # noqa: BLE001  (the session is gone)
        return False
