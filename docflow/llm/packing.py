"""Sequences of tokens packed along a space-filling curve, so that neighbours in a sequence are alike."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.bpe import LONG_PIECE, MATRIX_CELLS, Pairs, merge_long, merge_matrix
from docflow.llm.registry import query, table
from docflow.llm.words import Recent, by_bytes, gather, mix, strings, sums, thrifty, word_codes, word_hashes

DIMENSIONS, BITS = 4, 15
#: Documents that the bounds of the tasks' stretches are taken from, about so many.
BOUND_SAMPLE = 20_000
SEQUENCE_TOKENS = 2048
END_ID = 1
CACHED_WORDS = 80_000
PLAIN = "^[!-~\u00a1-\u012f\u0131-\u024f]+$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of whole numbers below 2**bits along the Hilbert curve of that many dimensions.

    Skilling's transform: undo the turns of each level, Gray-decode, then interleave the bits.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def project(texts: pa.Array) -> np.ndarray:
    """Hashed word counts of each text, projected by random signs to a few whole coordinates. Words are lower-cased."""
    words, starts = word_hashes(pc.ascii_lower(texts))
    signs, scale = mix(words, 9), np.sqrt(np.maximum(np.diff(starts), 1))
    points = np.empty((len(texts), DIMENSIONS), np.int64)
    for i in range(DIMENSIONS):
        sign = ((signs >> np.uint64(i)) & np.uint64(1)).astype(np.int8) * 2 - 1
        points[:, i] = (0.5 + 0.5 * np.tanh(sums(sign, starts) / scale / 2)) * ((1 << BITS) - 1)
    return points


class WordBpe(Pairs):
    """Merges of a tokenizer file with word ends, and the ids that bytes begin as, inside and at the end of a piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(path), Recent(CACHED_WORDS)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        # The byte-level alphabet: printable bytes are their own letters, others follow from U+0100 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.inside = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.at_end = np.array([ids[letters[b] + end] for b in range(256)], np.int32)
        super().__init__({(ids[a] << 32) | ids[b]: ids[a + b] for a, b in model["merges"]})


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def piece_ids(bpe: WordBpe, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces behind each other, and their starts, merged in matrices of pieces of similar length."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    content, lengths = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.diff(offsets)
    counts, done = np.zeros(len(pieces), np.int64), []
    widths = np.maximum(-(-lengths // 4) * 4, 4)
    for width in np.unique(widths[lengths > 0]):
        members = np.flatnonzero((widths == width) & (lengths > 0))
        for at in range(0, len(members), max(1, MATRIX_CELLS // width)):
            rows = members[at:at + max(1, MATRIX_CELLS // width)]
            inside = np.arange(width)[None, :] < lengths[rows][:, None]
            places = np.where(inside, offsets[rows][:, None] + np.arange(width)[None, :], 0)
            ids = np.where(inside, bpe.inside[content[places]], -1)
            last = lengths[rows] - 1
            ids[np.arange(len(rows)), last] = bpe.at_end[content[offsets[rows] + last]]
            if width > LONG_PIECE:
                found = [merge_long(bpe, row[row >= 0].tolist()) for row in ids]
                merged = np.full((len(rows), max(map(len, found))), -1, np.int32)
                for row, x in zip(merged, found):
                    row[:len(x)] = x
            else:
                merged = merge_matrix(bpe, ids.astype(np.int32))
            counts[rows] = (merged >= 0).sum(axis=1)
            done.append((rows, merged))
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(starts[-1]), np.int32)
    for rows, merged in done:
        kept = merged >= 0
        flat[(starts[rows][:, None] + np.arange(merged.shape[1])[None, :])[kept]] = merged[kept]
    return flat, starts


def word_ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words behind each other, and the words' starts.

    A word of plain Latin letters between punctuation is lowered and cut into
    those three pieces, as the tokenizer's split does, and each different piece
    is merged once. Other words go through the tokenizer whole.
    """
    bpe = _tokenizer(path)
    lower = pc.utf8_lower(words)
    behind = pc.utf8_ltrim(lower, PUNCTUATION)
    stem = pc.utf8_rtrim(behind, PUNCTUATION)
    size, after, inner = (np.asarray(pc.utf8_length(x)).astype(np.int64) for x in (lower, behind, stem))
    plain = np.asarray(pc.match_substring_regex(words, PLAIN)) & ~np.asarray(pc.match_substring_regex(lower, "^[^a-z]*'|<[|]"))
    plain &= np.asarray(pc.or_(pc.utf8_is_alpha(stem), pc.equal(stem, "")))
    odd = np.flatnonzero(~plain)
    parts = [_cut(lower, np.zeros(len(size), np.int64), size - after), stem, _cut(behind, inner, after)]
    parts = [pc.if_else(pa.array(plain), x, "") for x in parts]
    coded = pa.concat_arrays([x.cast(pa.large_string()) for x in parts]).dictionary_encode()
    flat, starts = piece_ids(bpe, coded.dictionary)
    codes = np.asarray(coded.indices).astype(np.int64).reshape(3, -1).T.copy()
    if len(odd):
        texts = words.take(pa.array(odd)).to_pylist()
        new = bpe.known.missing(texts)
        for at in range(0, len(new), 50_000):
            found = bpe.tokenizer.encode_batch_fast(new[at:at + 50_000], add_special_tokens=False)
            bpe.known.update((w, array("i", f.ids).tobytes()) for w, f in zip(new[at:at + 50_000], found))
        whole = [bpe.known[t] for t in texts]
        codes[odd, 0] = len(starts) - 1 + np.arange(len(odd))
        starts = np.concatenate([starts, starts[-1] + np.cumsum([len(w) // 4 for w in whole])])
        flat = np.concatenate([flat, np.frombuffer(b"".join(whole), np.int32)])
    ids, lengths = gather(flat, starts, codes.ravel())
    return ids, np.concatenate([[0], np.cumsum(lengths)])[::3]


def _cut(texts: pa.Array, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """ASCII ends of texts: the code points from start to stop, counted from the front or, behind letters, the back."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = stop - start
    from_back = start > 0
    begin = np.where(from_back, offsets[1:] - size, offsets[:-1])
    content, lengths = gather(np.frombuffer(texts.buffers()[2] or b"", np.uint8),
                              np.column_stack([begin, begin + size]).ravel(), np.arange(0, 2 * len(size), 2))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(content))])


def token_ids(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, each with its end id, and the texts' starts.

    The tokenizer never looks across ASCII white space, so each different
    word of the batch is encoded once.
    """
    codes, starts, words = word_codes(texts)
    flat, flat_starts = word_ids(path, words)
    ids, lengths = gather(flat, flat_starts, codes)
    ends = np.concatenate([[0], np.cumsum(lengths)])[starts]
    out = np.full(len(ids) + len(texts), end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
    return out, ends + np.arange(len(ends))


def pack_stream(documents: Iterator[tuple[int, np.ndarray]], size: int, first_id: int) -> Iterator[tuple]:
    """Lay documents behind each other in sequences of `size` ids.

    What is left at the end is cut at powers of two, so that it needs no padding.
    """
    sequence, held, room = first_id, [], size
    for doc_id, ids in documents:
        start = 0
        while start < len(ids):
            part = ids[start:start + room]
            held.append((doc_id, start, part, len(ids)))
            start += len(part)
            room -= len(part)
            if not room:
                yield from _sequence(held, sequence)
                sequence, held, room = sequence + 1, [], size
    left = size - room
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = []
        while room:
            doc_id, start, part, total = held.pop(0)
            now.append((doc_id, start, part[:room], total))
            if len(part) > room:
                held.insert(0, (doc_id, start + room, part[room:], total))
            room -= len(now[-1][2])
        yield from _sequence(now, sequence)
        sequence += 1


def _sequence(held: list, sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, part, total in held:
        yield doc_id, start, len(part), zlib.crc32(part.tobytes()), total, sequence, offset
        offset += len(part)


def task_of(place: np.ndarray, low: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the bounds, sorted rows of (place, low), each row is not before."""
    first, behind = (np.searchsorted(bounds[:, 0], place, side) for side in ("left", "right"))
    task = first.copy()
    for at in np.unique(first[behind > first]).tolist():  # places that some bound has, as those of many copies
        rows = np.flatnonzero((first == at) & (behind > first))
        task[rows] += np.searchsorted(bounds[at:behind[rows[0]], 1], low[rows], "right")
    return task


def _placed(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows with their place on the curve and the task whose stretch that is; rows with equal places go by `_low`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts):
                part = batch.slice(at, stop - at)
                place, low = hilbert_key(project(texts.slice(at, stop - at))), np.asarray(part.column(2))
                yield pa.record_batch([*part.columns, pa.array(place), pa.array(task_of(place, low, bounds).astype(np.int32))],
                                      names=["doc_id", "text", "_low", "_place", "_task"])

    return rows.mapInArrow(thrifty(run), "doc_id long, text string, _low long, _place long, _task int")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents, packed gaplessly into sequences of `size` ids in the order of a Hilbert curve.

    A document's hashed word counts are projected to `DIMENSIONS` coordinates;
    rows are range partitioned and sorted by their place on the curve, equal
    places by a hash of the id, and each task lays its stretch of the curve
    out. So no group of copies has to fit in a task. The bounds of the
    stretches come from a sample, which only decides which task packs what.
    A null or empty text is its end id alone; a null id stays null, and
    repeated rows are packed each. An empty table gives no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long")).alias("_low"))
    share = min(1.0, BOUND_SAMPLE / max(1, rows.count()))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = _placed(rows.sample(share, seed=1), np.zeros((0, 2), np.int64))
    drawn = np.array(sorted(map(tuple, sample.select("_place", "_low").collect())), np.int64).reshape(-1, 2)
    bounds = np.unique(drawn[[len(drawn) * i // tasks for i in range(1, tasks)]] if len(drawn) else drawn, axis=0)
    ordered = (_placed(rows, bounds).repartitionById(len(bounds) + 1, "_task")
               .sortWithinPartitions("_place", "_low", "doc_id", F.xxhash64("text")).select("doc_id", "text"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            for batch in batches:
                texts = strings(batch.column("text"))
                doc_ids = batch.column("doc_id").to_pylist()
                for at, stop in by_bytes(texts, 4 << 20):
                    ids, starts = token_ids(tokenizer_path, texts.slice(at, stop - at), end_id)
                    for i, doc_id in enumerate(doc_ids[at:stop]):
                        yield doc_id, ids[starts[i]:starts[i + 1]]

        first, rows = TaskContext.get().partitionId() << 40, []
        for row in pack_stream(documents(), size, first):
            rows.append(row)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return ordered.mapInArrow(thrifty(lay_out), PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in PIECE.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_pack_along_curve")
def op9_pack_along_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe_path())
