import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import edge_rows, words

from docflow.llm.suffixes import GRAM, cut_passages, cut_repeats, triggers


def expected(rows, length):
    """Per row: bytes, removed bytes, removed runs and what is kept, by counting every passage."""
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((doc_id, len(t), int(gone.sum()), runs, kept))
    return out


def expected_passages(rows, size):
    """Per row: the text without words of repeated passages of `size` words, and how many went."""
    places = [[m.span() for m in re.finditer(r"[^ \t-\r]+", t or "")] for _, t in rows]
    found = [[t[a:b] for a, b in p] for (_, t), p in zip(rows, places)]
    times = Counter(tuple(w[i:i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for (doc_id, t), place, w in zip(rows, places, found):
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - size + 1):
            if times[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = True
        kept, done = "", 0
        for i, (a, b) in enumerate(place):
            if gone[i] and (i == 0 or not gone[i - 1]):
                kept += t[done:a]
            if gone[i] and not gone[i + 1]:
                done = b
        out.append((doc_id, t if t is None else kept + t[done:], int(gone.sum())))
    return out


def got(spark, rows, **how):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut_repeats(edge_rows(spark, rows).repartition(3), **how).collect()]


def shared_rows(length):
    source, rows = random.Random(length), []
    pool = [" ".join(words(100 + i, length // 3)) for i in range(6)] + ["é" * length, "ab" * length, "x" * (length - 1)]
    for i in range(60):
        parts = [" ".join(words(i, source.randint(1, length // 2)))]
        for _ in range(source.randint(0, 3)):
            piece = source.choice(pool)
            cut = source.randint(0, len(piece) // 3)
            parts.append(piece[cut:len(piece) - source.randint(0, len(piece) // 3)])
            parts.append("".join(source.choice("abé日") for _ in range(source.randint(0, 30))))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("length, reach, together", [(400, 200, 20_000), (40, 16, 20_000), (40, 16, 1), (25, 9, 2)])
def test_against_every_passage(spark, length, reach, together):
    rows = shared_rows(length) + [(None, "null id " * length), (100, None), (101, ""), (102, "short"), (103, "z" * 3 * length),
                                  (104, "same row " * length), (104, "same row " * length), (105, "y" * length)]
    assert sorted(got(spark, rows, length=length, reach=reach, together=together), key=repr) == sorted(expected(rows, length), key=repr)


def test_empty_table(spark):
    assert cut_repeats(edge_rows(spark, [])).count() == 0


def test_every_passage_has_one_trigger_within_reach():
    raw = np.random.default_rng(1).integers(97, 100, 4000).astype(np.uint8)
    starts = np.array([0, 1000, 1000, 1010, 4000])
    found = triggers(raw, starts, 40, 16)
    places = [p for a, b, _ in found for p in range(a, b + 1)]
    assert places == [p for s, e in zip(starts[:-1], starts[1:]) for p in range(s, e - 40 + 1)]
    assert all(b <= t < a + 16 for a, b, t in found) and GRAM + 16 <= 25


def test_query(spark):
    from docflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(found) == sorted((i, n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, n, gone, runs, kept in expected(rows, 400))


def test_passage_of_55_words_below_400_bytes(spark):
    """Passages count by words: 55 short words go from every text, 50 stay, white space between them does not matter."""
    passage, shorter = words(3, 55), words(4, 50)
    assert len(" ".join(passage)) < 400
    rows = [(i, f"head{i}  {(' ', chr(10))[i % 2].join(passage)} \ttail{i} {' '.join(shorter)} end{i}") for i in range(4)]
    docs = edge_rows(spark, rows)
    out = {r.doc_id: (r.text, r.n_removed, r._r1) for r in cut_passages(docs).collect()}
    assert out == {i: (f"head{i}   \ttail{i} {' '.join(shorter)} end{i}", 55, "x") for i in range(4)}


@pytest.mark.parametrize("size, together", [(51, 20_000), (6, 20_000), (3, 1)])
def test_passages_against_every_window(spark, size, together):
    rows = shared_rows(4 * size) + [(None, "no id " * 60), (100, None), (101, ""), (102, " \t"), (103, "z " * 200), (104, "same row " * 60),
                                    (104, "same row " * 60), (105, "a a b " * 90)]
    found = [(r.doc_id, r.text, r.n_removed) for r in cut_passages(edge_rows(spark, rows).repartition(3), words=size, together=together).collect()]
    assert sorted(found, key=repr) == sorted(expected_passages(rows, size), key=repr)
