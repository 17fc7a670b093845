"""Chat history on a turn table (session_id, turn, role, text)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.functions.text import role_line, word_count
from docflow.operators.ordered import part_of, running_sums
from docflow.session import task_files

TURN_KEY = ["session_id", "turn"]
RULE_LINE = "-" * 50
PART_TURNS = 1000


def new_session_key() -> Column:
    return F.concat(F.lit("session_"), F.uuid())


def list_sessions(chat: DataFrame, glob: str | None = None) -> DataFrame:
    """Session ids, all or those a key glob matches; reads the key column only."""
    sessions = chat.select("session_id")
    return (sessions if glob is None else sessions.filter(glob_condition(F.col("session_id"), glob))).distinct()


def glob_condition(key: Column, glob: str) -> Column:
    """Key glob (`*`, `?`, `[...]`) as a column; a plain prefix is also tested on its own so a scan can use it."""
    parts = re.findall(r"\\.|\[[^\]]*\]|\*|\?|[^\\\[*?]+|.", glob, re.S)
    pattern = "".join(
        {"*": ".*", "?": "."}.get(p) or (p if len(p) > 2 and p[0] == "[" else re.escape(p[1:] if p[0] == "\\" else p))
        for p in parts)
    condition = key.rlike(rf"(?s)\A{pattern}\z")
    prefix = re.match(r"[^\\\[*?]*", glob).group()
    return key.startswith(prefix) & condition if prefix else condition


def session_count(chat: DataFrame) -> DataFrame:
    return chat.agg(F.count_distinct("session_id").alias("n_sessions"))


def get_history(chat: DataFrame, session_id: str) -> DataFrame:
    """One session's turns in order; no rows for an unknown or an empty session."""
    return chat.filter(F.col("session_id") == session_id).orderBy("turn")


def session_exists(sessions: DataFrame, session_id: str) -> bool:
    return not sessions.filter(F.col("session_id") == session_id).isEmpty()


def with_line(chat: DataFrame) -> DataFrame:
    return chat.withColumn("line", role_line(F.col("role"), F.col("text")))


def session_history(chat: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Ordered lines per session as arrays of at most `part_turns` lines, numbered by `part`.

    A session of ordinary length has the single part 0; a huge one never
    becomes one row.
    """
    lines = with_line(chat).withColumn("part", part_of(F.col("turn"), part_turns))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("session_id", "part").agg(F.transform(ordered, lambda t: t["line"]).alias("history"))


def history_snapshots(chat: DataFrame) -> DataFrame:
    """What each stored snapshot adds.

    The store is rewritten after every assistant turn with the whole history so
    far. Snapshot n of a session is the rows with `snapshot_no <= n`, so the
    growing copies never have to be written out. Turns no assistant turn
    follows are in no snapshot.
    """
    lines = with_line(chat)
    counted = running_sums(lines, ["session_id"], "turn", {
        "replies": (F.col("role") == "assistant").cast("int"), "lines": F.lit(1), "chars": F.length("line")})
    is_reply = (F.col("role") == "assistant").cast("int")
    return (counted.withColumn("snapshot_no", F.col("run_replies") - is_reply + 1)
            .filter(F.col("snapshot_no") <= F.col("tot_replies"))
            .select("session_id", "turn", "line", "snapshot_no",
                    F.col("run_lines").alias("lines_so_far"), F.col("run_chars").alias("chars_so_far")))


def snapshot(snapshots: DataFrame, session_id: str, snapshot_no: int) -> DataFrame:
    """The lines stored by one snapshot, in order."""
    return snapshots.filter((F.col("session_id") == session_id) & (F.col("snapshot_no") <= snapshot_no)).orderBy("turn")


def memory_window(chat: DataFrame, limit: int = 3000, cost: Column | None = None,
                  start_with_user: bool = False) -> DataFrame:
    """The newest whole turns of each session whose costs sum to at most `limit`.

    Stops at the first turn that does not fit. `tokens_from_end` is the sum of
    the turn and all newer ones. Without a `cost` a turn costs its words, a
    blank one nothing.
    """
    cost = word_count(F.col("text")) if cost is None else cost
    kept = (running_sums(chat, ["session_id"], "turn", {"tokens": cost}, descending=True, limit=limit)
            .drop("tot_tokens").withColumnRenamed("run_tokens", "tokens_from_end"))
    if start_with_user:
        first = kept.groupBy("session_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("_first"))
        kept = kept.join(first, "session_id").filter(F.col("turn") >= F.col("_first")).drop("_first")
    return kept


def append_turns(chat: DataFrame, turns: DataFrame) -> DataFrame:
    """Stored turns and the new ones; a turn already stored is not added again."""
    return chat.unionByName(new_turns(chat, turns))


def new_turns(chat: DataFrame, turns: DataFrame) -> DataFrame:
    return turns.dropDuplicates(TURN_KEY).join(chat.select(*TURN_KEY), TURN_KEY, "left_anti").select(*chat.columns)


def upsert_sessions(current: DataFrame, updates: DataFrame, key: str = "session_id",
                    order: tuple[str, ...] = ("written_at",)) -> DataFrame:
    """One row per key: the one written last. Partial maxima are taken before the shuffle."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def transcript_lines(chat: DataFrame) -> DataFrame:
    """Rows (session_id, line_no, line): title at -2, rule at -1, then one line per turn."""
    header = list_sessions(chat).select("session_id", F.inline(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("line_no"),
                 F.concat(F.lit("CHAT HISTORY ("), "session_id", F.lit(")")).alias("line")),
        F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit(RULE_LINE).alias("line")))))
    body = with_line(chat).select("session_id", F.col("turn").cast("bigint").alias("line_no"), "line")
    return header.unionByName(body)


def export_transcripts(chat: DataFrame, path: str, folder_per_session: bool = True) -> None:
    """Write transcripts as text; the files of one folder, in name order, are the transcript.

    Range partitioning cuts a huge session into several files instead of
    sending it to one task.
    """
    lines = (transcript_lines(chat).repartitionByRange("session_id", "line_no")
             .sortWithinPartitions("session_id", "line_no"))
    if folder_per_session:
        lines.select("session_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("session_id").text(path)
    else:
        lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def pack_transcripts(chat: DataFrame, path: str, files: int) -> None:
    """Write transcripts into `files` text files at most, and an index of who lies where.

    Lines are range partitioned, so sessions lie behind each other in order and
    a huge one goes on in the next file. The index has a row per session and
    file: `session_id`, `first_line`, `file`, `begin`, `stop` (bytes). A file's
    name is new for every attempt of a task, and only indexed files count.
    """
    folder = f"{path.rstrip('/')}/files"
    lines = transcript_lines(chat).repartitionByRange(files, "session_id", "line_no").sortWithinPartitions("session_id", "line_no")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = task_files(folder)
        name, file, at, ranges = f"{uuid.uuid4().hex}.txt", None, 0, []
        for batch in batches:
            for session, number, line in zip(batch["session_id"], batch["line_no"], batch["line"]):
                if file is None:
                    system.create_dir(place, recursive=True)
                    file = system.open_output_stream(f"{place}/{name}")
                body = f"{line}\n".encode()
                if not ranges or ranges[-1][0] != session:
                    ranges.append([session, number, name, at, at])
                file.write(body)
                at += len(body)
                ranges[-1][4] = at
        if file is not None:
            file.close()
        yield pd.DataFrame(ranges, columns=["session_id", "first_line", "file", "begin", "stop"])

    index = lines.select("session_id", "line_no", "line").mapInPandas(write, "session_id string, first_line long, file string, begin long, stop long")
    index.write.mode("overwrite").parquet(f"{path.rstrip('/')}/index")


def read_transcripts(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """Rows (session_id, line_no, text) of packed transcripts, a row per file that a session lies in; `line_no` is that of
    its first line.

    `condition` on `session_id` is tested on the index, and only the byte
    ranges of what it keeps are read.
    """
    folder = f"{path.rstrip('/')}/files"
    index = spark.read.parquet(f"{path.rstrip('/')}/index")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = task_files(folder)
        for batch in batches:
            for session, first, name, begin, stop in batch.itertuples(index=False):
                with system.open_input_file(f"{place}/{name}") as file:
                    file.seek(begin)
                    yield pd.DataFrame({"session_id": [session], "line_no": [first], "text": [file.read(stop - begin).decode()]})

    wanted = index if condition is None else index.filter(condition)
    return wanted.mapInPandas(read, "session_id string, line_no long, text string")
