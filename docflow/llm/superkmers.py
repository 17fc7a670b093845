"""Windows of words that stand earlier too, counted in the buckets of their minimisers.

The minimiser of a window is the run of `MINIMISER` words in it with the least
hash. Consecutive windows that share one make a super-k-mer; equal windows have
equal minimisers, so they can only meet in the bucket of that. Super-k-mers
that agree as a whole are told apart by place alone. Of those that do not, one
of each kind travels to the bucket as one packed string, where the windows are
sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import HOT_ROWS, in_salts, tabled, with_row, with_row_key
from docflow.llm.words import by_bytes, give_back, mix, strings, thrifty, word_hashes

WINDOW, MINIMISER = 20, 5
#: Super-k-mers of one bucket that are sorted in one task; of more, each window is a row of its own.
TOGETHER = 20_000
#: Packed strings that one sorting task has on average.
TASK_UNITS = 3_000
PLACE = ["_id", "_r1", "_r2", "a"]


def super_kmers(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, n): the n windows that begin at word a and behind it share a minimiser; and the 64 bits of each one's minimiser.

    Texts lie behind each other, windows within one. Of equal hashes the
    leftmost counts, so the place of the minimiser follows from the window's words.
    """
    size = min(size, window)
    n, reach = len(hashes), window - size + 1
    ends = np.repeat(starts[1:], np.diff(starts))
    places = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(places):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    runs = np.concatenate([hashes, np.zeros(size, np.uint64)])
    grams = runs[:n]
    for i in range(1, size):
        grams = mix(grams, i) + runs[i:n + i]
    keys = (mix(grams, 11) & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    full = -(-n // reach) * reach
    blocks = np.concatenate([keys, np.full(full - n, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[places], ahead[places + reach - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    return np.column_stack([places[first], np.diff(np.concatenate([first, [len(places)]]))]), grams[at[first]]


def _units(base: DataFrame, window: int, size: int) -> DataFrame:
    """A row per super-k-mer: its place, number of windows, the minimiser `key` and a hash `whole` of all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(3))
            for at, stop in by_bytes(texts):
                hashes, starts = word_hashes(texts.slice(at, stop - at))
                found, keys = super_kmers(hashes, starts, window, size)
                view = memoryview(hashes)
                whole = [xxhash.xxh3_64_intdigest(view[a:a + n + window - 1]) for a, n in found.tolist()]
                doc = np.searchsorted(starts, found[:, 0], "right") - 1
                part, rows = batch.slice(at, stop - at), pa.array(doc)
                yield pa.record_batch([*[part.column(i).take(rows) for i in range(3)], pa.array((found[:, 0] - starts[doc]).astype(np.int32)),
                                       pa.array(found[:, 1].astype(np.int32)), pa.array(keys.view(np.int64)),
                                       pa.array(np.array(whole, np.uint64).view(np.int64))],
                                      names=[*PLACE, "n", "key", "whole"])

    rows = base.select("_row._id", "_r1", "_r2", "_text")
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        thrifty(run), f"_id {id_type}, _r1 long, _r2 long, a int, n int, key long, whole long")


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first of each salt of a group, with `later`: whether they stand behind the group's first one."""
    return rows.withColumn("later", F.row_number().over(W.partitionBy(*keys).orderBy(*PLACE)) > 1)


def _sorted_out(units: DataFrame, together: int, hot_rows: int) -> DataFrame:
    """The super-k-mers that matter further on: `later`, as the whole stands earlier too, or the first of their kind in a
    bucket with other kinds; `apart` marks buckets too large for one task.

    A frequent minimiser is dealt to salts by place: what is not the first of
    its kind there is later, and the firsts of all salts are put in order once
    more. Repeated rows stand at one place and count once.
    """
    salted, any_hot = in_salts(units, "key", ["_r1", "_r2", "a"], hot_rows)
    kind, bucket = W.partitionBy("key", "whole", "_salt").orderBy(*PLACE), W.partitionBy("key", "_salt")
    marked = salted.repartition("key", "_salt").withColumns({"_rank": F.rank().over(kind), "_no": F.row_number().over(kind)})
    marked = marked.withColumn("_kinds", F.sum((F.col("_no") == 1).cast("int")).over(bucket))
    columns = [*PLACE, "n", "key"]
    marked = marked.filter((F.col("_rank") > 1) | ((F.col("_no") == 1) & (F.col("_hot") | (F.col("_kinds") > 1)))).select(
        *columns, "whole", "_hot", (F.col("_rank") > 1).alias("later"), (F.col("_kinds") > together).alias("apart"))
    if not any_hot:
        return marked.select(*columns, "later", "apart")
    marked = tabled(marked, "super-kmer-kinds", few=False)
    heads = _in_order(marked.filter("_hot and not later").drop("later"), ["key", "whole"])
    return marked.filter("later or not _hot").select(*columns, "later", "apart").union(
        heads.select(*columns, "later", (~F.col("later")).alias("apart")))


def _packed(texts: DataFrame, window: int, apart: bool) -> DataFrame:
    """The wanted super-k-mers as packed strings, or with `apart` 128 bits of each of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, (text, units) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                words = text.encode().split()
                for u in units:
                    for a in range(u["a"], u["a"] + u["n"]) if apart else [u["a"]]:
                        packed = b" ".join(words[a:a + window + (0 if apart else u["n"] - 1)])
                        rows.append((i, a, u["n"], u["key"], xxhash.xxh3_128_digest(packed) if apart else packed))
                        size += len(rows[-1][4]) + 50
                if size > 4 << 20:
                    yield named(batch, rows)
                    rows, size = [], 0
            yield named(batch, rows)

    def named(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        doc, *columns = zip(*rows) if rows else [()] * 5
        doc = pa.array(doc, pa.int64())
        return pa.record_batch([*[batch.column(i).take(doc) for i in range(3)],
                                *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))]],
                               names=[*PLACE, "n", "key", "packed"])

    # With all columns, so that this and the final join share one shuffle of the texts.
    rows = texts.select("_row._id", "_r1", "_r2", "_text", "_units", "_row")
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(thrifty(run), f"_id {id_type}, _r1 long, _r2 long, a int, n int, key long, packed binary")


def _count_windows(window: int):
    def run(units: pa.Table) -> pa.Table:
        """Stretches (a, n) of windows that stand at an earlier place among the units.

        Units in the order of their places list the windows in that order too,
        and sorting keeps it among equal windows: all but the first of them go.
        """
        units = units.take(pc.sort_indices(units, sort_keys=[(c, "ascending") for c in PLACE], null_placement="at_start"))
        windows, unit, start, before = [], [], [], None
        for i, (*place, a, n, packed) in enumerate(zip(*[units[c].to_pylist() for c in ("_r1", "_r2", "a", "n", "packed")])):
            if (*place, a) == before:  # a repeated row
                continue
            before = (*place, a)
            words = packed.split(b" ")
            windows += [b" ".join(words[j:j + window]) for j in range(n)]
            unit += [i] * n
            start += range(a, a + n)
        order = sorted(range(len(windows)), key=windows.__getitem__)
        again = np.zeros(len(windows), bool)
        for before, this in zip(order, order[1:]):
            again[this] = windows[before] == windows[this]
        unit, start = np.array(unit, np.int64)[again], np.array(start, np.int64)[again]
        new = np.ones(len(unit), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        rows = pa.array(unit[first])
        sizes = np.diff(np.concatenate([first, [len(unit)]]))
        del windows
        give_back()
        return pa.table([units["_r1"].take(rows), units["_r2"].take(rows), pa.array(start[first].astype(np.int32)),
                         pa.array(sizes.astype(np.int32))], names=["_r1", "_r2", "a", "n"])

    return run


def repeated_windows(base: DataFrame, window: int = WINDOW, size: int = MINIMISER, together: int = TOGETHER,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stretches `_r1`, `_r2`, a, n: the n windows from word a on stand at an earlier place too."""
    units = tabled(_units(base, window, size), "super-kmers", few=False)
    found = tabled(_sorted_out(units, together, hot_rows), "super-kmer-places", few=False)
    late = found.filter("later").select("_r1", "_r2", "a", "n")

    def packed(apart: bool) -> DataFrame:
        by_doc = found.filter(~F.col("later") & (F.col("apart") == apart)).groupBy("_r1", "_r2").agg(
            F.collect_list(F.struct("a", "n", "key")).alias("_units"))
        return _packed(base.join(by_doc, ["_r1", "_r2"]), window, apart)

    bins = max(8, found.filter("not later and not apart").count() // TASK_UNITS)
    counted = packed(False).groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("_bin")).applyInArrow(
        _count_windows(window), "_r1 long, _r2 long, a int, n int")
    if not found.filter("not later and apart").limit(1).count():
        return late.union(counted)
    windows = tabled(packed(True).withColumn("_g", F.xxhash64("packed")), "windows", few=False)
    salted, _ = in_salts(windows, "_g", ["_r1", "_r2", "a"], hot_rows)
    order = W.partitionBy("packed", "_salt").orderBy(*PLACE)
    ranked = tabled(salted.withColumns({"_rank": F.rank().over(order), "_no": F.row_number().over(order)}).filter("_rank > 1 or _no = 1"),
                    "window-order", few=False)
    again = ranked.filter("_rank > 1").select("_r1", "_r2", "a").union(
        _in_order(ranked.filter("_rank = 1"), ["packed"]).filter("later").select("_r1", "_r2", "a"))
    return late.union(counted).union(again.withColumn("n", F.lit(1)))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 size: int = MINIMISER, together: int = TOGETHER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents' other columns with `n_words`, `n_removed` and `kept`, the remaining words joined by one space.

    Removed is each word that a window of `window` words covers whose words
    also stand, in that order, at an earlier place: in a document with a
    smaller id, or earlier in the same one. Windows are judged by the texts as
    they are given; words lie between the characters 20 and 09 to 0D (hex).

    A null id is the smallest. Of rows that agree in the id alone, a hash of
    the text says which is earlier; rows that agree in the text too are one
    document, each with that document's result. A null text has no words, and
    its `kept` is empty. The caller's columns are handed through, but for the
    text and those that bear the name of a result.

    Each text is read once for its minimisers and moved once. Super-k-mers
    whose minimiser is frequent are put in order in pieces, and so are windows,
    a row each, where one bucket has more than `together` kinds. So no bucket
    has to fit in a task. Whole super-k-mers, and single windows in those buckets, are
    compared by 64 and 128 bits of hash, all others word by word.
    """
    names = {"n_words", "n_removed", "kept"}
    others = [c for c in docs.columns if c != text_col and c not in names]
    kept = F.struct(F.col(f"`{id_col}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
    base = with_row_key(docs.select(kept.alias("_row"), F.col(f"`{text_col}`").alias("_text")), "_row._id", "_text")
    spans = repeated_windows(base, window, size, together, hot_rows).groupBy("_r1", "_r2").agg(
        F.collect_set(F.struct("a", "n")).alias("_spans"))
    none = F.array().cast("array<struct<a:int,n:int>>")
    rows = base.join(spans, ["_r1", "_r2"], "left").select("_row", "_text", F.array_sort(F.coalesce("_spans", none)).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts, 8 << 20):
                part, out = batch.slice(at, stop - at), []
                for text, spans in zip(texts.slice(at, stop - at).to_pylist(), part.column(2).to_pylist()):
                    words, kept, done = text.encode().split(), [], 0
                    for s in spans:
                        kept += words[done:max(done, s["a"])]
                        done = max(done, s["a"] + s["n"] + window - 1)
                    kept += words[done:]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept)))
                columns = list(zip(*out))
                yield pa.record_batch([part.column(0), *[pa.array(c, pa.int64()) for c in columns[:2]],
                                       pa.array(columns[2], pa.large_binary()).cast(pa.large_string())],
                                      names=["_row", "n_words", "n_removed", "kept"])

    cut = rows.mapInArrow(thrifty(run), with_row(rows, "n_words long, n_removed long, kept string"))
    return cut.select(*[F.col(f"_row._others.`{c}`") for c in others], "n_words", "n_removed", "kept")


@query("op11_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS k FROM s),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS no FROM late),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS no FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY no) AS text FROM each ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
