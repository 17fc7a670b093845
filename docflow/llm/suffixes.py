"""Passages that stand more than once in the corpus, found by prefix-free parsing.

A trigger is a byte whose rolling hash is the smallest within reach behind some
byte; triggers cut a text into phrases of `REACH` bytes at most, wherever the
text stands. So a suffix of the corpus is a suffix of a phrase, up to its
trigger, followed by a suffix of the parse, and equal passages have their
triggers at the same bytes.

Suffixes have to be ordered to the depth of a passage only. Suffixes of the
parse are dealt by the hash of the `LENGTH - REACH` bytes that all passages of
a trigger have in common. Where more than one surrounding shares these, two
suffix arrays are made: one of the parse, in the order of what follows the
trigger, and one of the dictionary, in the order of what goes before it, read
backwards. Passages are equal where an interval of the first, of suffixes with
a long enough common prefix, meets one of the second.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import HOT_ROWS, in_salts, tabled, with_row, with_row_key
from docflow.llm.words import by_bytes, give_back, mix, strings, thrifty, word_hashes

LENGTH, REACH, GRAM = 400, 200, 8
#: Words of a passage, where passages are counted in words, and the bytes that stand for one.
PASSAGE_WORDS, WORD_BYTES = 51, 8
#: From texts to bytes that are compared, and where each text's start.
Code = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: Suffixes of one parse suffix that are ordered in one task; of more, each place is a row of its own.
TOGETHER = 20_000
#: Places that one task of the ordering has on average, and cells of a matrix that strings are compared in.
TASK_UNITS, CELLS = 3_000, 4 << 20


def triggers(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, reach: int = REACH) -> np.ndarray:
    """Rows (a, b, t): the passages that start at bytes a to b of the texts have their trigger at t.

    The trigger of a passage is the first byte with the smallest hash of
    `GRAM` bytes among its first `reach` bytes. Texts lie behind each other;
    only passages within one text count.
    """
    n = len(raw)
    if n < length:
        return np.zeros((0, 3), np.int64)
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)])
    grams = np.empty(n, np.uint64)
    for i in range(GRAM):
        part = padded[i:i + (n + GRAM - 1 - i) // GRAM * GRAM].view(np.uint64)
        grams[i::GRAM] = part[:len(grams[i::GRAM])]
    keys = (mix(grams, 3) & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    full = -(-n // reach) * reach
    blocks = np.concatenate([keys, np.full(full - n, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    ends = np.repeat(starts[1:], np.diff(starts))
    places = np.flatnonzero(np.arange(n) + length <= ends)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    at = (np.minimum(behind[places], ahead[places + reach - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(places)]]) - 1
    return np.column_stack([places[first], places[last], at[first]])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and where each text starts."""
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
    return content, starts - starts[0]


def _coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`WORD_BYTES` bytes of hash for each word of the texts, and where each text starts."""
    hashes, starts = word_hashes(texts)
    return hashes.view(np.uint8), starts * WORD_BYTES


def _units(base: DataFrame, length: int, reach: int, code: Code) -> DataFrame:
    """A row per trigger: the bytes a to b whose passages have it, the hash `key` of the parse suffix there, to the
    depth that all those passages reach, and the hash `whole` of all they cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            for at, stop in by_bytes(texts):
                raw, starts = code(texts.slice(at, stop - at))
                found = triggers(raw, starts, length, reach)
                doc = np.searchsorted(starts, found[:, 0], "right") - 1
                view = memoryview(raw)
                key = [xxhash.xxh3_64_intdigest(view[t:t + length - reach]) for t in found[:, 2].tolist()]
                whole = [xxhash.xxh3_64_intdigest(view[a:b + length]) for a, b in found[:, :2].tolist()]
                a, b, t = (found - starts[doc][:, None]).astype(np.int32).T
                rows = pa.array(doc)
                part = batch.slice(at, stop - at)
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(a), pa.array(b), pa.array(t),
                                       pa.array(np.array(key, np.uint64).view(np.int64)),
                                       pa.array(np.array(whole, np.uint64).view(np.int64))],
                                      names=["_r1", "_r2", "a", "b", "t", "key", "whole"])

    return base.select("_r1", "_r2", "_text").mapInArrow(thrifty(run), "_r1 long, _r2 long, a int, b int, t int, key long, whole long")


def _excerpts(wanted: DataFrame, length: int, apart: bool, code: Code) -> DataFrame:
    """The bytes of the wanted units, or with `apart` 128 bits of each of their passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for r1, r2, text, units in zip(*(batch.column(i).to_pylist() for i in range(4))):
                content = code(pa.array([text or ""], pa.large_string()))[0].tobytes()
                for u in units:
                    for a in range(u["a"], u["b"] + 1) if apart else [u["a"]]:
                        part = content[a:(a if apart else u["b"]) + length]
                        rows.append((u["key"], r1, r2, a, u["t"] - u["a"], u["sure"], xxhash.xxh3_128_digest(part) if apart else part))
                        size += len(rows[-1][-1]) + 50
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
            yield _rows(rows)

    return wanted.mapInArrow(thrifty(run), "key long, _r1 long, _r2 long, a int, before int, sure boolean, content binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                           names=["key", "_r1", "_r2", "a", "before", "sure", "content"])


def suffix_array(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and how many bytes each shares with the one before it in that order, `depth` at most.

    Strings that end are shorter than others that go on.
    """
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    common = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), CELLS // depth):
        rows = [strings[i][:depth] for i in order[at - 1:at + CELLS // depth].tolist()]
        sizes = np.array([len(r) for r in rows])
        matrix = np.frombuffer(b"".join(r.ljust(depth, b"\0") for r in rows), np.uint8).reshape(len(rows), depth)
        differ = matrix[1:] != matrix[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        common[at:at + len(rows) - 1] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return order, common


def equal_passages(contents: list[bytes], before: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit, start) of the passages that another unit has too.

    A unit's passages start at its first `counts` bytes, its trigger is `before`
    bytes behind the first. A passage with s bytes before the trigger is equal
    to another one if the dictionary agrees on the s bytes before it and the
    parse on the other `length` - s: if both lie in one interval of each array.
    """
    if not contents:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = int(before.max()) + 1
    parse, follows = suffix_array([c[n:] for c, n in zip(contents, before.tolist())], length)
    words, precedes = suffix_array([c[:n][::-1] for c, n in zip(contents, before.tolist())], reach)
    n = len(contents)
    in_parse, in_words = np.empty(n, np.int64), np.empty(n, np.int64)
    units, starts = [], []
    for s in range(int((before - counts + 1).min()), reach):
        in_parse[parse] = np.cumsum(follows < length - s)
        in_words[words] = np.cumsum(precedes < s)
        own = np.flatnonzero((s <= before) & (before - s < counts))
        both = in_parse[own] * (n + 1) + in_words[own]
        _, place, times = np.unique(both, return_inverse=True, return_counts=True)
        own = own[times[place] > 1]
        units.append(own)
        starts.append(before[own] - s)
    return np.concatenate(units), np.concatenate(starts)


def _order(length: int):
    def run(units: pd.DataFrame) -> pd.DataFrame:
        """Stretches [a, b] of starts whose passage stands again among the units.

        A sure unit's passages stand elsewhere as well, so it says nothing of its own.
        """
        before = units["before"].to_numpy(np.int64)
        counts = np.array([len(c) - length + 1 for c in units["content"]], np.int64)
        unit, start = equal_passages(units["content"].tolist(), before, counts, length)
        again = ~units["sure"].to_numpy(bool)[unit]
        unit, start = unit[again], start[again]
        order = np.lexsort((start, unit))
        unit, start = unit[order], start[order] + units["a"].to_numpy(np.int64)[unit[order]]
        new = np.ones(len(unit), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(unit)]])[:len(first)] - 1
        of = unit[first]
        give_back()
        return pd.DataFrame({"_r1": units["_r1"].to_numpy()[of], "_r2": units["_r2"].to_numpy()[of],
                             "a": start[first].astype(np.int32), "b": start[last].astype(np.int32)})

    return run


def _sorted_out(units: DataFrame, together: int, hot_rows: int) -> DataFrame:
    """Units that matter further on: `sure`, as all they cover stands again, and `wanted`, one for each different whole of
    a parse suffix that has a whole of its own and another one. `apart` marks suffixes with too many for one task.

    The units of a frequent parse suffix are counted in salts, and the first
    ones of all salts once more.
    """
    salted, any_hot = in_salts(units, "key", ["_r1", "_r2", "a"], hot_rows)
    kind, bucket = W.partitionBy("key", "whole", "_salt"), W.partitionBy("key", "_salt")
    marked = salted.repartition("key", "_salt").withColumns({
        "_n": F.count("*").over(kind), "_no": F.row_number().over(kind.orderBy("_r1", "_r2", "a"))})
    marked = marked.withColumns({"_kinds": F.sum((F.col("_no") == 1).cast("int")).over(bucket), "_least": F.min("_n").over(bucket)})
    mixed = (F.col("_no") == 1) & (F.col("_hot") | ((F.col("_kinds") > 1) & (F.col("_least") == 1)))
    columns = ["_r1", "_r2", "a", "b", "t", "key"]
    marked = marked.select(*columns, "whole", "_hot", (F.col("_n") > 1).alias("sure"), mixed.alias("wanted"),
                           (F.col("_kinds") > together).alias("apart")).filter("sure or wanted")
    if not any_hot:
        return marked.select(*columns, "sure", "wanted", "apart")
    marked = tabled(marked, "parse-counts", few=False)
    whole = W.partitionBy("key", "whole")
    heads = marked.filter("_hot and wanted").withColumns({
        "_heads": F.count("*").over(whole), "_head": F.row_number().over(whole.orderBy("_r1", "_r2", "a"))})
    heads = heads.select(*columns, (F.col("sure") | (F.col("_heads") > 1)).alias("sure"), (F.col("_head") == 1).alias("wanted"), F.lit(True).alias("apart"))
    return marked.filter("not (_hot and wanted)").select(*columns, "sure", "wanted", "apart").union(heads)


def repeated_starts(base: DataFrame, length: int = LENGTH, reach: int = REACH, together: int = TOGETHER, code: Code = _raw,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stretches `_r1`, `_r2`, a, b: the passages of `length` bytes that start at a to b of the coded text stand elsewhere too."""
    units = tabled(_units(base, length, reach, code), "parse", few=False)
    found = tabled(_sorted_out(units, together, hot_rows), "parse-kinds", few=False)
    sure = found.filter("sure").select("_r1", "_r2", "a", "b")

    def texts(apart: bool) -> DataFrame:
        by_doc = found.filter(F.col("wanted") & (F.col("apart") == apart)).groupBy("_r1", "_r2").agg(
            F.collect_list(F.struct("a", "b", "t", "key", "sure")).alias("_units"))
        # With all columns, so that this and the final join share one shuffle of the texts. Rows that agree in id and text
        # come as often as they are there, which their count says already.
        return base.join(by_doc, ["_r1", "_r2"]).select("_r1", "_r2", "_text", "_units", "_row")

    bins = max(8, found.filter("wanted and not apart").count() // TASK_UNITS)
    compared = _excerpts(texts(False), length, False, code).groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("_bin")).applyInPandas(
        _order(length), "_r1 long, _r2 long, a int, b int")
    if not found.filter("wanted and apart").limit(1).count():
        return sure.union(compared)
    places = tabled(_excerpts(texts(True), length, True, code).withColumn("_g", F.xxhash64("content")), "passages", few=False)
    salted, _ = in_salts(places, "_g", ["_r1", "_r2", "a"], hot_rows)
    part = W.partitionBy("content", "_salt")
    counted = tabled(salted.withColumns({"_n": F.count("*").over(part), "_no": F.row_number().over(part.orderBy("_r1", "_r2", "a"))}), "passage-counts", few=False)
    heads = counted.filter("_no = 1").withColumn("_heads", F.count("*").over(W.partitionBy("content"))).filter("_n > 1 or _heads > 1")
    again = heads.select("_r1", "_r2", "a", "sure").union(counted.filter("_no > 1").select("_r1", "_r2", "a", "sure"))
    return sure.union(compared).union(again.filter("not sure").select("_r1", "_r2", "a", F.col("a").alias("b")))


def _with_spans(docs: DataFrame, others: list[str], id_col: str, text_col: str, length: int, reach: int, together: int, code: Code) -> DataFrame:
    """`_row` (the other columns), `_text`, `_spans` (from byte a to byte e of the coded text, sorted, maybe overlapping)."""
    base = with_row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                                    F.col(f"`{text_col}`").alias("_text")), "_id", "_text").select("_row", "_text", "_r1", "_r2")
    spans = repeated_starts(base, length, reach, together, code).groupBy("_r1", "_r2").agg(
        F.collect_set(F.struct("a", (F.col("b") + length).alias("e"))).alias("_spans"))
    none = F.array().cast("array<struct<a:int,e:int>>")
    return base.join(spans, ["_r1", "_r2"], "left").select("_row", "_text", F.array_sort(F.coalesce("_spans", none)).alias("_spans"))


def _merged(spans: list[dict]) -> list[list[int]]:
    """Maximal runs of sorted spans."""
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["a"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["e"])
        else:
            merged.append([s["a"], s["e"]])
    return merged


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                reach: int = REACH, together: int = TOGETHER) -> DataFrame:
    """The documents' other columns with `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept`, the remaining bytes.

    Removed is each byte that a passage of `length` bytes covers which also
    starts anywhere else, in the same text or another one, by the texts as
    they are given. Texts are UTF-8; passages lie within one row. Each row is
    a text of its own, so equal rows of enough bytes lose them all. A null
    text is empty.

    Repeats of a whole unit are counted by hash, and only units whose
    surroundings differ somewhere send their bytes. Frequent parse suffixes are
    counted in salts, and those with more than `together` different
    surroundings, as around a passage that very many texts have, are compared
    passage by passage by 128 bits of hash, so no group has to fit in a task.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = _with_spans(docs, others, id_col, text_col, length, reach, together, _raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts, 8 << 20):
                part, out = batch.slice(at, stop - at), []
                for text, spans in zip(texts.slice(at, stop - at).to_pylist(), part.column(2).to_pylist()):
                    content, merged = text.encode(), _merged(spans)
                    bounds = [0, *(x for m in merged for x in m), len(content)]
                    kept = b"".join(content[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                    out.append((len(content), len(content) - len(kept), len(merged), kept))
                numbers = [pa.array(c, pa.int64()) for c in list(zip(*out))[:3]]
                yield pa.record_batch([part.column(0), *numbers, pa.array([o[3] for o in out], pa.binary())],
                                      names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = rows.mapInArrow(thrifty(run), with_row(rows, "n_bytes long, n_removed long, n_spans long, kept binary"))
    return cut.select(*[F.col(f"_row.`{c}`") for c in others], "n_bytes", "n_removed", "n_spans", "kept")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS,
                 together: int = TOGETHER) -> DataFrame:
    """The documents' columns without passages that stand elsewhere too, and `n_removed`, the number of words that went.

    A passage is `words` words in a row, whatever white space (20 and 09 to 0D,
    hex) is between them; each word that one covers goes, in all its places,
    and with it the white space inside a removed run. All else stays as it is.
    Null texts, repeated rows and empty tables are as in `cut_repeats`.

    Each word is coded in `WORD_BYTES` bytes, so passages of as many words have
    as many bytes, and those are what `repeated_starts` compares. A word counts
    as covered if all its bytes are: passages that begin inside a word's bytes
    agree in all but two words, and in parts of those, only if a passage that
    begins with a word does too, up to a chance of 2^-32.
    """
    length = words * WORD_BYTES
    others = [c for c in docs.columns if c != text_col]
    rows = _with_spans(docs, others, id_col, text_col, length, min(REACH, length // 2), together, _coded_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(1).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for i, spans in enumerate(batch.column(2).to_pylist()):
                runs = [(-(-a // WORD_BYTES), e // WORD_BYTES) for a, e in _merged(spans)]
                if runs:
                    content, kept, done = texts[i].encode(), [], 0
                    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", content)]
                    for first, stop in runs:
                        kept.append(content[done:places[first][0]])
                        done = places[stop - 1][1]
                        removed[i] += stop - first
                    texts[i] = b"".join([*kept, content[done:]]).decode()
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(removed)], names=["_row", "_text", "n_removed"])

    cut = rows.mapInArrow(thrifty(run), with_row(rows, "_text string, n_removed long"))
    return cut.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns], "n_removed")


@query("op3_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
marked AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS first FROM r)),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM marked GROUP BY doc_id, span),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans),
cut AS (SELECT doc_id, count(*) AS n, sum(e - s)::bigint AS removed, max(e) AS last,
               string_agg(substr(h, (2 * b + 1)::bigint, (2 * (s - b))::bigint), '' ORDER BY s) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::bigint))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
