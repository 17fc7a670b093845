import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.sources.files import scan_files
from docflow.streaming import landing
from docflow.streaming.ingest import landed_files


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(landing, "PART_FILES", 10)


def land(folder, names, text="text"):
    for at, name in enumerate(names):
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"{text} {name}")
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


def batches(files, checkpoint):
    """The names of each batch."""
    seen = []
    files.writeStream.foreachBatch(lambda batch, _: seen.append([r.file_name for r in batch.orderBy("last_modified").collect()])).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return seen


def remembered(checkpoint):
    """What the stream's driver has noted in its checkpoint as seen."""
    return [json.loads(line)["path"] for log in Path(checkpoint, "sources", "0").iterdir() if log.name.isdigit()
            for line in log.read_text().splitlines() if line.startswith("{")]


def test_a_stream_remembers_parts_and_not_files(spark, tmp_path, small_parts):
    names = [f"{i % 3}/{i}.txt" for i in range(25)]
    land(tmp_path / "in", names)
    files = landed_files(spark, str(tmp_path / "in"), "*.txt")
    assert sorted(sum(batches(files, str(tmp_path / "c")), [])) == sorted(n.split("/")[1] for n in names)
    noted = remembered(tmp_path / "c")
    assert len(noted) == 3 and not any(path.endswith(".txt") for path in noted)


def test_batches_follow_the_age_of_files_and_of_landings(spark, tmp_path, small_parts):
    names = [f"{i * 7 % 40}.txt" for i in range(40)]
    land(tmp_path / "in", names)
    first = batches(landed_files(spark, str(tmp_path / "in"), most=25), str(tmp_path / "c"))
    assert first == [names[:20], names[20:]]
    land(tmp_path / "in", ["late, but old.txt"])
    assert batches(landed_files(spark, str(tmp_path / "in"), most=25), str(tmp_path / "c")) == [["late, but old.txt"]]
    assert batches(landed_files(spark, str(tmp_path / "in"), most=25), str(tmp_path / "c")) == []
    assert sum(batches(landed_files(spark, str(tmp_path / "in"), most=25), str(tmp_path / "other")), []) == [*names, "late, but old.txt"]


@pytest.mark.parametrize("glob", ["*", "*.txt", "{a,b}*.[tT]xt", "?.txt", "*(1)*"])
def test_streamed_files_are_the_rows_of_a_scan(spark, tmp_path, glob):
    land(tmp_path / "in", ["a.txt", "b.Txt", "b b (1).txt", "x=1/ä%20é.txt", "deep/er/a.txt", "_hidden.txt", ".dot.txt", "_kept=1.txt", "_metadata.txt",
                           "_gone/a.txt", "_metadata_of/a.txt", "a\n.txt", "c.txt._COPYING_", "no extension"])
    (tmp_path / "in" / "empty").mkdir()
    stored, seen = scan_files(spark, str(tmp_path / "in"), glob), []
    landed_files(spark, str(tmp_path / "in"), glob).writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == sorted(stored.collect()) and seen


def test_a_folder_may_be_a_glob_or_empty_but_not_missing(spark, tmp_path):
    land(tmp_path, ["d1/a.txt", "d2/b.txt", "e/c.txt", "d3.txt"])
    assert sorted(sum(batches(landed_files(spark, f"{tmp_path}/d*", "*.txt"), str(tmp_path / "c1")), [])) == ["a.txt", "b.txt", "d3.txt"]
    assert batches(landed_files(spark, f"{tmp_path}/none*"), str(tmp_path / "c2")) == []
    (tmp_path / "empty").mkdir()
    assert batches(landed_files(spark, str(tmp_path / "empty")), str(tmp_path / "c3")) == []
    with pytest.raises(FileNotFoundError):
        landed_files(spark, str(tmp_path / "missing"))


def test_a_stream_that_goes_on_sees_what_lands_later(spark, tmp_path):
    land(tmp_path / "in", ["a.txt"])
    seen = []
    query = (landed_files(spark, str(tmp_path / "in")).filter(F.col("file_extension") == "txt").writeStream
             .foreachBatch(lambda batch, _: seen.extend(r.file_name for r in batch.collect()))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start())
    try:
        for name in ("b.txt", "c.txt"):
            land(tmp_path / "in", [name])
            until = time.monotonic() + 60
            while name not in seen and time.monotonic() < until:
                query.awaitTermination(0.2)
    finally:
        query.stop()
    assert sorted(seen) == ["a.txt", "b.txt", "c.txt"]


def test_a_broken_listing_is_made_whole_and_none_is_made_twice(spark, tmp_path, small_parts, monkeypatch):
    names = [f"{i}.txt" for i in range(35)]
    land(tmp_path / "in", names)
    index = landing.landing(spark, str(tmp_path / "in"), "*", 10, str(tmp_path))
    moved, move, write_once = [], landing._move, landing.write_once

    def breaks(spark, path, name):
        if len(moved) == 2:
            raise RuntimeError("lost")
        moved.append(name)
        move(spark, path, name)

    monkeypatch.setattr(landing, "_move", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        index.refresh(spark)
    assert spark.read.parquet(index.place).count() == 20
    monkeypatch.setattr(landing, "_move", move)
    assert index.refresh(spark) == 0
    assert spark.read.parquet(index.place).count() == 35

    def another_is_first(*note):
        monkeypatch.setattr(landing, "write_once", write_once)
        assert index.refresh(spark) == 3
        write_once(*note)

    late = [f"late {i}.txt" for i in range(3)]
    land(tmp_path / "in", late)
    monkeypatch.setattr(landing, "write_once", another_is_first)
    assert index.refresh(spark) == 0
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(index.place).collect()) == sorted([*names, *late])
    assert sorted(p.name for p in Path(index.place).iterdir() if p.name[0] != ".") == [*(f"{k:012d}.parquet" for k in range(1, 6)), "_runs"]
