"""Documents drawn so that their features come near those of a target text collection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import tabled, with_row
from docflow.llm.words import by_bytes, strings, thrifty
from docflow.operators.ordered import rank_rows

BUCKETS, GRAMS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of the widest matrix; a longer feature is several rows of it.
PIECE = 256
MATRIX_CELLS = 8 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each byte, and what `PIECE` zero bytes make of each byte of a CRC, by its place."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    shift = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(PIECE):
        shift = one[shift & 255] ^ (shift >> np.uint32(8))
    return one, shift


def _columns(matrix: np.ndarray, state: np.uint32) -> np.ndarray:
    """CRC registers of all rows, which begin as `state`, after one column at a time."""
    one, _ = _tables()
    crc = np.full(len(matrix), state, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = one[(crc ^ column) & 255] ^ (crc >> np.uint32(8))
    return crc


def _pieces(content: np.ndarray, begin: int, size: int) -> np.uint32:
    """CRC register of one long feature: its pieces as rows of one matrix, joined from the first to the last.

    Zero bytes in front leave an empty register empty, so the first piece is filled up with them once the
    register's beginning is put into the feature's first four bytes.
    """
    _, shift = _tables()
    padded = np.zeros(-(-size // PIECE) * PIECE, np.uint8)
    padded[-size:] = content[begin:begin + size]
    at = len(padded) - size
    padded[at:at + 4] ^= 255
    crc = np.uint32(0)
    for piece in _columns(padded.reshape(-1, PIECE), np.uint32(0)):
        crc = shift[0, crc & 255] ^ shift[1, (crc >> 8) & 255] ^ shift[2, (crc >> 16) & 255] ^ shift[3, crc >> 24] ^ piece
    return crc


def crc_matrix(features: pa.Array) -> np.ndarray:
    """CRC-32 of each feature's bytes (a large_binary array): a matrix per length, all its rows at once, column by column."""
    offsets = np.frombuffer(features.buffers()[1], np.int64)[features.offset:features.offset + len(features) + 1]
    content, sizes = np.frombuffer(features.buffers()[2] or b"", np.uint8), np.diff(offsets)
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, begins = np.unique(sizes[order], return_index=True)
    for size, members in zip(lengths.tolist(), np.split(order, begins[1:])):
        if size > PIECE:
            out[members] = [_pieces(content, offsets[m], size) for m in members]
            continue
        for at in range(0, len(members), max(1, MATRIX_CELLS // max(size, 1))):
            rows = members[at:at + max(1, MATRIX_CELLS // max(size, 1))]
            out[rows] = _columns(content[offsets[rows][:, None] + np.arange(size)[None, :]], np.uint32(0xFFFFFFFF))
    return ~out


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, starts, words): words[codes[starts[i]:starts[i + 1]]] are the words of text i, as bytes.

    Words are runs of digits, ASCII letters, lower-cased, and all characters beyond ASCII.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw, bounds = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]
    raw = raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
    inside = ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    begins[edges] = inside[edges]
    held = np.cumsum(inside)
    places = np.flatnonzero(begins)
    ends = np.concatenate([held[places] - 1, held[-1:] if len(held) else [0]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), np.searchsorted(places, bounds), coded.dictionary


def feature_buckets(texts: pa.Array, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `grams` words: the bucket of every feature of the texts, and where each text's features start."""
    codes, starts, words = plain_words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    runs, features = codes, words
    for size in range(1, grams + 1):
        if size > 1:
            keep = np.flatnonzero(text[size - 1:] == text[:len(text) - size + 1])
            both, runs_of = np.unique(runs[keep] * len(words) + codes[keep + size - 1], return_inverse=True)
            features = pc.binary_join_element_wise(features.take(pa.array(both // len(words))), words.take(pa.array(both % len(words))),
                                                   pa.scalar(b" ", pa.large_binary())) if len(both) else features.slice(0, 0)
            runs = np.zeros(len(text), np.int64)
            runs[keep] = runs_of
            yield (crc_matrix(features) % buckets)[runs_of], np.searchsorted(text[keep], np.arange(len(texts) + 1))
        else:
            yield (crc_matrix(words) % buckets)[codes], starts


def bucket_counts(docs: DataFrame, text_col: str, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `n`: features of all texts in each bucket that has any. A task sends one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = strings(batch.column(0))
            for at, stop in by_bytes(texts):
                for found, _ in feature_buckets(texts.slice(at, stop - at), grams, buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(thrifty(run), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all buckets on the driver: as many numbers as there are buckets."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat, rounded down, that each bucket is likelier in the target, with one added to every count."""
    ratio = ((target + 1.0) * (float(corpus.sum()) + len(corpus))) / ((corpus + 1.0) * (float(target.sum()) + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, text_col: str, gain: np.ndarray, keep: list[str], grams: int = GRAMS) -> DataFrame:
    """`_row` (the columns to keep), `n_words`, `n_features`, `weight` of each document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts):
                numbers = np.zeros((3, stop - at), np.int64)
                for size, (found, starts) in enumerate(feature_buckets(texts.slice(at, stop - at), grams, buckets)):
                    total = np.concatenate([[0], np.cumsum(gain[found])])
                    numbers += [np.diff(starts) * (size == 0), np.diff(starts), np.diff(total[starts])]
                yield pa.record_batch([batch.column(0).slice(at, stop - at), *map(pa.array, numbers)],
                                      names=["_row", "n_words", "n_features", "weight"])

    return rows.mapInArrow(thrifty(run), with_row(rows, "n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED,
             keep: list[str] | None = None) -> DataFrame:
    """Every document with `n_features`, `weight`, `score` and `rank`; the drawn documents are those with a rank.

    Features are runs of 1 to `grams` words in `buckets` hash buckets. The
    weight adds up how much likelier each is in `target` than in `docs`; with
    Gumbel noise by seed and id on top, the largest scores are a draw without
    replacement by importance. Of the N documents with `min_words` words,
    floor(percent * N / 100) are drawn, ties to the smaller id.

    A null text has no words. A null id takes part like an empty one and comes
    before all others among ties; rows that agree in id and text are drawn one
    by one. Either table may be empty. `keep` names the columns to hand on
    (all, text included, if not given), but for those that bear the name of a
    result.

    Each text is read twice, for the counts and for the weights. Counts leave a
    task as a row per bucket. Ranks come from a range partitioning by score and
    id; what else could be equal is spread by place.
    """
    names = {"n_features", "weight", "score", "rank"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    gain = gains(_dense(bucket_counts(docs, text_col, grams, buckets), buckets),
                 _dense(bucket_counts(target, target_col, grams, buckets), buckets))
    rows = weighed(docs, text_col, gain, list(dict.fromkeys([id_col, *kept])), grams).withColumn("_id", F.col(f"_row.`{id_col}`"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    scored = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    # Written once: sampling for the ranges would read and weigh all texts again.
    scored = tabled(scored.withColumns({"_short": F.col("n_words") < min_words, "_down": -F.col("score"),
                                        "_at": F.monotonically_increasing_id()}), "scored", few=False)
    drawn = percent * scored.filter("not _short").count() // 100
    ranked = rank_rows(scored, [], ["_short", "_down", "_id", "_at"], "_rank")
    return ranked.select(*[F.col(f"_row.`{c}`") for c in kept], "n_features", "weight", "score",
                         F.when(~F.col("_short") & (F.col("_rank") <= drawn), F.col("_rank")).alias("rank"))


@query("op13_importance_resample", r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
crc AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
        4294967295) % 10000 AS bucket FROM hexed),
counted AS (SELECT kind, bucket, count(*) AS n FROM words JOIN crc USING (word) GROUP BY ALL),
gain AS (SELECT range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((SELECT coalesce(sum(n), 0) FROM counted WHERE kind = 'd') + 10000)::double
           / ((coalesce(s.n, 0) + 1)::double * ((SELECT coalesce(sum(n), 0) FROM counted WHERE kind = 'b') + 10000)::double)))::bigint AS gain
         FROM range(10000) LEFT JOIN (FROM counted WHERE kind = 'd') s ON s.bucket = range LEFT JOIN (FROM counted WHERE kind = 'b') t ON t.bucket = range),
weights AS (SELECT id, count(*) AS n, sum(gain)::bigint AS weight FROM words JOIN crc USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
             (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double / 4294967296::double)))::bigint AS score
           FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)""")
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
