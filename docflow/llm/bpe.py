"""Byte-level BPE over whole columns: padded matrices of byte pieces, merged row by row in numpy."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.words import Recent, by_bytes, gather, stretches, strings, thrifty

NONE = np.int32(2**31 - 1)
LONG_PIECE = 128
MATRIX_CELLS = 1 << 19
CACHED_CHUNKS = 100_000


class Pairs:
    """Ranks of pairs of ids in an open-addressing hash table; a merged pair's rank is its id."""

    def __init__(self, pairs: dict[int, int]):
        self.pairs = pairs
        self.size = 1 << (4 * len(pairs)).bit_length()
        self.shift = np.uint64(64 - self.size.bit_length() + 1)
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & (self.size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where it doesn't merge. Negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (self.size - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return np.where((left >= 0) & (right >= 0), out, NONE)


class Ranks(Pairs):
    """Byte pairs of a rank file, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = {rank: token for token, rank in self.ranks.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        super().__init__(pairs)


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def merge_matrix(ranks: Pairs, ids: np.ndarray) -> np.ndarray:
    """Ids of padded rows after all merges. Each round merges every row's leftmost pair of least rank.

    Rows without a pair left go to the output; the others move together, and
    only the two pairs beside a merge are looked up again.
    """
    out = np.full_like(ids, -1)
    rows = np.arange(len(ids))
    pairs = ranks.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while len(rows):
        at = pairs.argmin(axis=1) if pairs.shape[1] else np.zeros(len(rows), np.int64)
        least = pairs[np.arange(len(rows)), at] if pairs.shape[1] else np.full(len(rows), NONE)
        done = least == NONE
        if done.any():
            out[rows[done], :ids.shape[1]] = ids[done]
            rows, ids, pairs, at, least = rows[~done], ids[~done], pairs[~done], at[~done], least[~done]
            if not len(rows):
                break
        here, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
        ids[here, at] = least
        behind = columns[None, :] > at[:, None]
        ids = np.where(behind, ids[:, 1:], ids[:, :-1])
        pairs = np.where(behind[:, :-1], pairs[:, 1:], pairs[:, :-1]) if pairs.shape[1] > 1 else pairs[:, :0]
        if pairs.shape[1]:
            left = np.maximum(at - 1, 0)
            pairs[here, left] = np.where(at > 0, ranks.lookup(ids[here, left], ids[here, left + 1]), pairs[here, left])
            right = np.minimum(at, pairs.shape[1] - 1)
            pairs[here, right] = np.where(at < ids.shape[1] - 1, ranks.lookup(ids[here, right], ids[here, right + 1]),
                                          pairs[here, right])
    return out


def merge_long(ranks: Pairs, ids: list[int]) -> list[int]:
    """Ids of one long piece, by the same order of merges from a heap of pairs: a matrix would cost its length squared."""
    pairs, after, before = ranks.pairs, list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(rank, i) for i in range(len(ids) - 1) if (rank := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= len(ids) or pairs.get((ids[i] << 32) | ids[j]) != rank:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(ids) and (rank := pairs.get((ids[k] << 32) | ids[after[k]])) is not None:
                heappush(heap, (rank, k))
    return [x for x in ids if x >= 0]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as 32-bit numbers, from matrices of pieces of similar length."""
    out: list = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.ranks.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(piece) > LONG_PIECE:
            out[i] = np.array(merge_long(ranks, ranks.of_byte[np.frombuffer(piece, np.uint8)].tolist()), np.int32).tobytes()
        else:
            buckets.setdefault(max(4, -(-len(piece) // 4) * 4), []).append(i)
    for width, members in buckets.items():
        for at in range(0, len(members), MATRIX_CELLS // width):
            part = members[at:at + MATRIX_CELLS // width]
            lengths = np.array([len(pieces[i]) for i in part])
            matrix = np.full((len(part), width), -1, np.int32)
            matrix[np.arange(width)[None, :] < lengths[:, None]] = ranks.of_byte[
                np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            merged = merge_matrix(ranks, matrix)
            ends, flat = 4 * (merged >= 0).sum(axis=1), merged.tobytes()
            for i, start, end in zip(part, range(0, len(flat), 4 * width), ends.tolist()):
                out[i] = flat[start:start + end]
    return out


@lru_cache(maxsize=2)
def _chunks(path: str) -> Recent:
    return Recent(CACHED_CHUNKS)


def chunk_ids(path: str, pattern: str, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk of text as 32-bit numbers; those of frequent chunks are kept between batches."""
    import regex

    ranks, known, split = load(path), _chunks(path), regex.compile(pattern)
    new = known.missing(chunks)
    split_new = [[p.encode() for p in split.findall(c)] for c in new]
    place = {p: i for i, p in enumerate(dict.fromkeys(p for pieces in split_new for p in pieces))}
    ids = encode_pieces(ranks, list(place))
    for chunk, pieces in zip(new, split_new):
        known[chunk] = b"".join([ids[place[p]] for p in pieces])
    return [known[c] for c in chunks]


def encode_batch(path: str, pattern: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, and the texts' starts.

    No match of the pattern has a blank anywhere but in front or within white
    space. So a text can be cut before each blank, and each different chunk is
    encoded once, unless the blank stands between white space and more white
    space or the end; such texts are encoded whole.
    """
    lists = pc.split_pattern(texts, " ")
    starts = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = values.dictionary_encode()
    codes, parts = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    begins = np.array([not p or p[0].isspace() for p in parts], bool)
    ends = np.array([not p or p[-1].isspace() for p in parts], bool)
    first = np.zeros(len(codes), bool)
    first[starts[:-1]] = True
    risky = begins[codes] & ~first
    risky[1:] &= ends[codes[:-1]]
    whole = np.add.reduceat(risky, starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    # The first part of a text has no blank in front of it; a text that is not cut is one chunk.
    alone = [t if w else t.split(" ", 1)[0] for t, w in zip(texts.to_pylist(), whole)]
    inner = np.repeat(whole, np.diff(starts)) & ~first
    codes[first] = len(parts) + np.arange(len(texts))
    codes = codes[~inner]
    chunks = [" " + p for p in parts] + alone
    used = np.unique(codes)
    found = chunk_ids(path, pattern, [chunks[i] for i in used])
    sizes = np.zeros(len(chunks), np.int64)
    sizes[used] = [len(x) // 4 for x in found]
    flat_starts = np.concatenate([[0], np.cumsum(sizes)])
    ids, lengths = gather(np.frombuffer(b"".join(found), np.int32), flat_starts, codes)
    starts = np.concatenate([[0], np.cumsum(~inner)])[starts]
    return ids, np.concatenate([[0], np.cumsum(lengths)])[starts]


def decode_batch(path: str, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of ids behind each other, and the rows' starts."""
    ranks = load(path)
    out, lengths = gather(ranks.bytes, ranks.starts, ids)
    return out, np.concatenate([[0], np.cumsum(lengths)])[starts]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           batch_bytes: int = 2 << 20) -> DataFrame:
    """`id_col` and `ids` (array of int) of each text's byte-level BPE tokens, special tokens never.

    A null or empty text has no ids. Nulls and repeats of the id stay as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts, batch_bytes):
                ids, starts = encode_batch(path, pattern, texts.slice(at, stop - at))
                yield pa.record_batch([batch.column(0).slice(at, stop - at), pa.ListArray.from_arrays(starts.astype(np.int32), ids)],
                                      names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(thrifty(run), f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids",
           batch_ids: int = 1 << 19) -> DataFrame:
    """The ids again, with the bytes they stand for. No ids, or null, are no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for at, stop in stretches(lengths, batch_ids):
                part = batch.slice(at, stop - at)
                lists, starts = part.column(1), np.concatenate([[0], np.cumsum(lengths[at:stop])])
                found, starts = decode_batch(path, np.asarray(lists.flatten()), starts)
                content = pa.Array.from_buffers(pa.large_binary(), len(lists), [
                    None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))])
                yield pa.record_batch([part.column(0), lists, content.cast(pa.binary())], names=[id_col, ids_col, "content"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(thrifty(run), f"`{id_col}` {kind}, `{ids_col}` array<int>, content binary")


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"),
                         F.sha2("content", 256).alias("decoded_sha256"))
