import glob
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docflow.operators import chat, context, store
from docflow.operators.ordered import rank_rows, running_sums
from docflow.schema import CHAT
from docflow.streaming import chat as stream

TURNS = [("session_1", 1, "user", "where is çay?"), ("session_1", 2, "assistant", "On the second shelf, behind the flour 🫖"),
         ("session_1", 3, "user", "u2"), ("session_1", 4, "assistant", "a2"), ("session_1", 5, "user", "unanswered"),
         ("sessionX1", 1, "system", "s"), ("user_1", 1, "user", "x")]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, CHAT)


def words(spark, counts):
    return spark.createDataFrame(
        [("s", i + 1, "user" if i % 2 == 0 else "assistant", " ".join(["w"] * n)) for i, n in enumerate(counts)], CHAT)


def test_lookups(turns):
    assert chat.get_history(turns, "nobody").count() == 0
    assert [r.turn for r in chat.get_history(turns, "session_1").collect()] == [1, 2, 3, 4, 5]
    assert chat.session_exists(turns, "user_1") and not chat.session_exists(turns, "nobody")
    assert chat.session_count(turns).first().n_sessions == 3


@pytest.mark.parametrize("pattern, expected", [
    ("session_*", ["session_1"]), ("session?1", ["sessionX1", "session_1"]), ("*[rX]*1", ["sessionX1", "user_1"]),
    (r"session\_1", ["session_1"]), ("*", ["sessionX1", "session_1", "user_1"]), ("session_", []), ("a.b", [])])
def test_globs(turns, pattern, expected):
    assert sorted(r.session_id for r in chat.list_sessions(turns, pattern).collect()) == expected


def test_a_glob_prefix_reaches_the_scan(spark, turns, folder):
    turns.write.parquet(f"{folder}/t")
    plan = chat.list_sessions(spark.read.parquet(f"{folder}/t"), "session_*")._jdf.queryExecution().toString()
    assert "StringStartsWith(session_id,session_)" in plan
    assert "ReadSchema: struct<session_id:string>" in plan


def test_snapshots_grow(turns):
    stored = chat.history_snapshots(turns)
    first = [r.line for r in chat.snapshot(stored, "session_1", 1).collect()]
    assert first == ["User: where is çay?", "Assistant: On the second shelf, behind the flour 🫖"]
    assert [r.line for r in chat.snapshot(stored, "session_1", 2).collect()] == first + ["User: u2", "Assistant: a2"]
    assert stored.filter("session_id <> 'session_1' or turn = 5").count() == 0


def test_history_is_cut_into_parts(spark):
    history = chat.session_history(words(spark, [1] * 7), part_turns=3)
    assert {r.part: len(r.history) for r in history.collect()} == {0: 2, 1: 3, 2: 2}


@pytest.mark.parametrize("part_rows", [1, 2, 10_000])
def test_memory_golden(spark, part_rows, monkeypatch):
    monkeypatch.setattr("docflow.operators.ordered.running_sums.__defaults__", (False, part_rows, None))
    assert sorted(r.turn for r in chat.memory_window(words(spark, [5, 4, 3, 2]), 6).collect()) == [3, 4]
    assert chat.memory_window(words(spark, [5, 4, 3, 2]), 1).count() == 0


def test_memory_does_not_skip_a_turn_that_is_too_long(spark):
    assert sorted(r.turn for r in chat.memory_window(words(spark, [1, 9, 1]), 5).collect()) == [3]


def test_blank_turns_cost_nothing(spark):
    assert chat.memory_window(words(spark, [0] * 20), 3).count() == 20
    assert sorted(r.turn for r in chat.memory_window(words(spark, [9, 0, 2, 0, 1, 0]), 3).collect()) == [2, 3, 4, 5, 6]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_a_sparse_order(spark, descending):
    df = spark.range(400).selectExpr("if(id < 300, 'hot', 'k') k", "id * 1000003 * 1009 - 77 AS pos", "id % 11 AS v")
    out = running_sums(df, ["k"], "pos", {"v": F.col("v")}, descending).collect()
    total, run = {}, {}
    for r in sorted(out, key=lambda r: -r.pos if descending else r.pos):
        run[r.k] = run.get(r.k, 0) + r.v
        assert r.run_v == run[r.k]
        total[r.k] = r.tot_v
    assert total == run and len(out) == 400


def test_memory_may_have_to_start_with_a_user(spark):
    kept = chat.memory_window(words(spark, [5, 4, 3, 2]), 9, start_with_user=True)
    assert sorted(r.turn for r in kept.collect()) == [3, 4]


@pytest.mark.parametrize("part_rows", [1, 7, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_one_huge_group(spark, part_rows, descending):
    df = spark.range(200).selectExpr("if(id < 150, 'hot', concat('k', id % 5)) k", "id * 3 AS pos", "id % 11 AS v")
    out = running_sums(df, ["k"], "pos", {"v": F.col("v")}, descending, part_rows).collect()
    assert len(out) == 200
    for r in out:
        mates = [x for x in out if x.k == r.k]
        assert r.run_v == sum(x.v for x in mates if (x.pos >= r.pos if descending else x.pos <= r.pos))
        assert r.tot_v == sum(x.v for x in mates)
    capped = running_sums(df, ["k"], "pos", {"v": F.col("v")}, descending, part_rows, limit=40).collect()
    assert sorted(capped) == sorted(r for r in out if r.run_v <= 40)


def test_ranks_of_one_huge_group(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 'hot', concat('k', id % 5)) k", "id % 7 AS score", "id AS member")
    rows = rank_rows(df.repartition(6), ["k"], ["score", "member"]).collect()
    expected = {}
    for r in sorted(rows, key=lambda r: (r.k, r.score, r.member)):
        expected[r.k] = expected.get(r.k, 0) + 1
        assert r["rank"] == expected[r.k]
    assert len(rows) == 3000


def transcript(path):
    parts = sorted(glob.glob(f"{path}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_transcript_files(turns, folder):
    chat.export_transcripts(turns, folder + "/out")
    assert transcript(folder + "/out/session_id=session_1").splitlines() == [
        "CHAT HISTORY (session_1)", "-" * 50, "User: where is çay?", "Assistant: On the second shelf, behind the flour 🫖",
        "User: u2", "Assistant: a2", "User: unanswered"]
    assert len([d for d in os.listdir(folder + "/out") if d.startswith("session_id=")]) == 3
    chat.export_transcripts(turns, folder + "/flat", folder_per_session=False)
    assert transcript(folder + "/flat").count("CHAT HISTORY") == 3


def test_append_is_idempotent(spark, turns):
    again = chat.append_turns(turns, turns.unionAll(spark.createDataFrame([("new", 1, "user", "hi")], CHAT)))
    assert again.count() == len(TURNS) + 1
    assert chat.append_turns(again, again).count() == len(TURNS) + 1


def test_last_write_wins(spark):
    shape = "session_id string, written_at int, history array<string>"
    old = spark.createDataFrame([("a", 1, ["x"]), ("b", 1, ["y"])], shape)
    new = spark.createDataFrame([("a", 2, ["x", "z"]), ("c", 1, [])], shape)
    assert {r.session_id: r.history for r in chat.upsert_sessions(old, new).collect()} == {
        "a": ["x", "z"], "b": ["y"], "c": []}


def test_session_keys(spark):
    keys = [r.k for r in spark.range(3).select(chat.new_session_key().alias("k")).collect()]
    assert len(set(keys)) == 3 and all(len(k) == 44 and k.startswith("session_") for k in keys)


def test_stream_equals_batch_and_repeats_add_nothing(spark, turns, folder):
    landing, table = f"{folder}/landing", f"{folder}/table"
    turns.write.parquet(landing)

    def run(checkpoint):
        landed = spark.readStream.schema(CHAT).parquet(landing)
        stream.stream_chat_append(landed, table, f"{folder}/{checkpoint}").awaitTermination()
        return sorted(map(tuple, stream.stored_turns(spark, table).select(*CHAT.names).collect()))

    assert run("c1") == sorted(TURNS)
    late = ("session_1", 6, "assistant", "late")
    spark.createDataFrame([late, TURNS[0]], CHAT).write.mode("append").parquet(landing)
    assert run("c1") == sorted([*TURNS, late])
    assert run("c2") == sorted([*TURNS, late])      # a lost checkpoint replays everything


def test_streamed_histories_follow_new_turns(spark, turns, folder):
    landing = f"{folder}/landing"

    def run():
        landed = spark.readStream.schema(CHAT).parquet(landing)
        stream.stream_session_upsert(landed, f"{folder}/t", f"{folder}/h", f"{folder}/c").awaitTermination()
        return {(r.session_id, r.part): r.history for r in stream.latest_histories(spark, f"{folder}/h").collect()}

    turns.write.parquet(landing)
    assert run()["user_1", 0] == ["User: x"]
    spark.createDataFrame([("user_1", 2, "assistant", "y")], CHAT).write.mode("append").parquet(landing)
    histories = run()
    assert histories["user_1", 0] == ["User: x", "Assistant: y"]
    assert len(histories["session_1", 0]) == 5


def test_context_and_prompts(spark):
    hits = spark.createDataFrame([("q", 2, "c d"), ("q", 1, "a b"), ("q", 3, "e f g")], "query_id string, rank int, text string")
    packed = context.compact_context(hits, 4)
    assert tuple(packed.first()) == ("q", 2, 4, "a b\n\nc d")
    asked = spark.createDataFrame([("q", "why?"), ("r", "how?")], "session_id string, question string")
    lines = spark.createDataFrame([("q", 2, "Assistant: b"), ("q", 1, "User: a")], "session_id string, turn int, line string")
    prompts = {r.session_id: r.prompt for r in context.build_prompts(
        asked, lines, packed.withColumnRenamed("query_id", "session_id"), "Be brief.").collect()}
    assert prompts["q"] == "Be brief.\n\nHistory:\nUser: a\nAssistant: b\n\nContext:\na b\n\nc d\n\nQuestion: why?"
    assert prompts["r"] == "Be brief.\n\nHistory:\n\n\nContext:\n\n\nQuestion: how?"


def test_packed_transcripts(spark, folder):
    """Few files, a range per session and file; a huge session goes on in the next file; letters of several bytes."""
    rows = [(f"s{i}", t, "user", f"türkçe 😊 {i} {t}\nsecond line") for i in range(20) for t in range(3)]
    rows += [("s5x", t, "assistant", f"line {t}") for t in range(2000)] + [("blank", 1, "user", None)]
    turns = spark.createDataFrame(rows, CHAT).repartition(5)
    chat.pack_transcripts(turns, folder, 4)
    assert len(list(Path(f"{folder}/files").glob("*.txt"))) <= 4
    want = {}
    for session, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        head = f"CHAT HISTORY ({session})\n{'-' * 50}\n"
        want[session] = want.get(session, head) + f"{role.capitalize()}: {text or ''}\n"
    got = {}
    for r in sorted(chat.read_transcripts(spark, folder).collect(), key=lambda r: (r.session_id, r.line_no)):
        got[r.session_id] = got.get(r.session_id, "") + r.text
    assert got == want
    (own,) = chat.read_transcripts(spark, folder, F.col("session_id") == "s7").collect()
    assert (own.line_no, own.text) == (-2, want["s7"])
    assert chat.read_transcripts(spark, folder, F.col("session_id") == "nobody").count() == 0


def test_histories_are_compacted(spark, turns, folder):
    """After compaction each part is stored once, in one part of the store, and later batches count on top of it."""
    def held():
        return sorted((r.session_id, r.part, r.history) for r in stream.latest_histories(spark, folder).collect())

    assert stream.latest_histories(spark, f"{folder}/none").count() == 0
    for last in (1, 2, 9):
        stream.add_histories(chat.session_history(turns.filter(F.col("turn") <= last), 2), folder)
    want = sorted((r.session_id, r.part, r.history) for r in chat.session_history(turns, 2).collect())
    assert held() == want
    assert store.manifest(spark, folder).stale > 0
    stream.compact_histories(spark, folder, many=0, keep=1)
    now = store.manifest(spark, folder)
    assert now.stale == 0 and len(now.parts["histories"]) == 1 and held() == want
    assert store.read_table(spark, folder, now, "histories").count() == len(want)
    assert len(store._names(spark, f"{folder}/histories")) == 1
    stream.add_histories(spark.createDataFrame([("user_1", 0, ["User: new"])], "session_id string, part long, history array<string>"), folder)
    assert ("user_1", 0, ["User: new"]) in held() and len(held()) == len(want)
