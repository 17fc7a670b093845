import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import edge_rows, words
from pyspark.sql import functions as F

from docflow.llm.resample import PIECE, crc_matrix, resample


def features(text, grams):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return found, [zlib.crc32(" ".join(found[i:i + n]).encode()) for n in range(1, grams + 1) for i in range(len(found) - n + 1)]


def expected(rows, target, grams=1, buckets=10_000, percent=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) of each row; among equal rows any may be first."""
    source = Counter(f % buckets for _, t in rows for f in features(t, grams)[1])
    wanted = Counter(f % buckets for t in target for f in features(t, grams)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out, long = [], []
    for doc_id, text in rows:
        found, hashed = features(text, grams)
        weight = sum(math.floor(1000 * math.log((wanted[f % buckets] + 1) * (s_all + buckets) / ((source[f % buckets] + 1) * (t_all + buckets))))
                     for f in hashed)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(hashed), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(found) >= min_words:
            long.append(out[-1])
    long.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for place, row in enumerate(long[:percent * len(long) // 100], 1):
        ranks.setdefault(row, []).append(place)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=repr)


def cases():
    source = random.Random(8)
    rows = [(i, " ".join(words(i, source.randint(0, 60), 300)).title()) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "?! --"), (None, " ".join(words(1, 30))), (1003, "日本語" * 900 + " é ß" * 30)]
    rows += [(2000, " ".join(words(2, 40)))] * 60  # a fifth of what is long enough, equal in all columns
    return rows, [" ".join(words(i, 30, 300)) for i in range(0, 40, 3)] + [None, ""]


@pytest.mark.parametrize("grams, buckets, percent", [(1, 10_000, 10), (3, 50, 100), (2, 1, 0)])
def test_against_plain_version(spark, grams, buckets, percent):
    rows, target = cases()
    docs = edge_rows(spark, rows).withColumns({"rank": F.lit("mine"), "_row": F.lit(1)}).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample(docs, wanted, grams=grams, buckets=buckets, percent=percent)
    assert out.columns == ["doc_id", "text", "_r1", "_line", "ids", "_row", "n_features", "weight", "score", "rank"]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=repr)
    assert got == expected(rows, target, grams, buckets, percent)


def test_empty_tables(spark):
    rows, target = cases()
    empty = edge_rows(spark, [])
    assert resample(empty, empty).count() == 0
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(edge_rows(spark, rows), empty).collect()), key=repr)
    assert got == expected(rows, [])


def test_crc_of_all_lengths():
    source = np.random.default_rng(3)
    sizes = [*range(70), PIECE - 1, PIECE, PIECE + 1, PIECE + 3, 2 * PIECE, 2 * PIECE + 4, 5000, 70_001] * 2
    values = [source.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes] + [b"\x00" * 300, b"\xff" * 257]
    got = crc_matrix(pa.array(values, pa.large_binary()).slice(1))
    assert got.tolist() == [zlib.crc32(v) for v in values[1:]]
