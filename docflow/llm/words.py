"""Words of a batch of texts as numbers, for the operators that count or look words up in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text whose words are split and coded together.
PIECE_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library frees on its own
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a task, with the memory it freed given back at the end."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(words, starts): words[starts[i]:starts[i + 1]] are the words of text i, in their order.

    Words are what lies between the characters 20 and 09 to 0D (hex).
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    starts = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    full = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        values = values.filter(pa.array(full))
    return values, starts


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, starts, words): words[codes[starts[i]:starts[i + 1]]] are the words of text i, as `split_words` has them.

    Texts are split a piece at a time, as all their words take several times their room.
    """
    parts, counts = [], [np.zeros(1, np.int64)]
    for at, stop in by_bytes(texts, PIECE_BYTES):
        values, starts = split_words(texts.slice(at, stop - at), lower)
        parts.append(values.dictionary_encode())
        counts.append(np.diff(starts))
    if len(parts) < 2:
        coded = parts[0] if parts else pa.array([], pa.large_string()).dictionary_encode()
        return np.asarray(coded.indices), np.cumsum(np.concatenate(counts)), coded.dictionary
    coded = pa.chunked_array(parts).unify_dictionaries()
    return np.concatenate([np.asarray(part.indices) for part in coded.chunks]), np.cumsum(np.concatenate(counts)), coded.chunk(0).dictionary


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word of the texts, and each text's first word."""
    codes, starts, words = word_codes(texts)
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    return known[codes] if len(known) else np.zeros(0, np.uint64), starts


def stretches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to `limit` at most, each of one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, stop
        at = stop


def by_bytes(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about `limit` bytes of text."""
    return stretches(np.asarray(pc.binary_length(texts)).astype(np.int64), limit)


class Recent(dict):
    """What was looked up lately: when `limit` new keys have come, those not asked for since the last time go."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: Iterable) -> list:
        """The different keys that are not known; the others are marked as asked for."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        out = []
        for key in dict.fromkeys(keys):
            if key not in self:
                value = self.older.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out


def crcs(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word's UTF-8 bytes."""
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits for each unsigned number."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i, empty stretches included."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return np.diff(total[starts])


def gather(flat: np.ndarray, flat_starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[flat_starts[c]:flat_starts[c + 1]] of all codes behind each other, and their lengths."""
    lengths = np.diff(flat_starts)[codes]
    total = int(lengths.sum())
    shift = np.repeat(flat_starts[codes] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(codes) else
                      np.zeros(0, np.int64), lengths)
    return flat[np.arange(total) + shift], lengths
