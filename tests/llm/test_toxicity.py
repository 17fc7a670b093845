import itertools
import math
import os
import random
import re
import string
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from brute import edge_rows, words

from docflow.llm.toxicity import BUCKETS, Model, fit, score, segments


def brute_segments(scores):
    """Maximal segments by their definition, recursively: the best one, then what lies left and right of it."""
    def best(lo, hi):
        found = [(sum(scores[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        found = [f for f in found if f[0] > 0]
        if not found:
            return []
        top = max(f[0] for f in found)
        a, b = min(((a, b) for s, _, a, b in found if s == top), key=lambda x: x[1] - x[0])
        return best(lo, a) + [(a, b, top)] + best(b, hi)

    return best(0, len(scores))


def test_segments_against_their_definition():
    source = random.Random(2)
    for _ in range(300):
        scores = [source.choice([-5, -3, -2, -1, 1, 2, 4]) + source.random() / 8 for _ in range(source.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in segments(np.array(scores))]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_rows(spark):
    bad = ["vilest", "rotten", "filth"]
    docs, labels = [], []
    for i in range(200):
        text = words(i, 120)
        toxic = i % 4 == 0
        for k in range(3 if toxic else 0):
            text.insert(10 * k, bad[k])
        docs.append((i, " ".join(text)))
        if i >= 40:
            labels.append((i, int(toxic)))
    odd = [(None, "filth! rotten vilest"), (900, None), (901, ""), (902, "x " * 100_000), (0, docs[0][1])]
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (45, 0)], "doc_id long, toxic int")
    model = fit(edge_rows(spark, docs + odd), table)
    got = score(edge_rows(spark, docs + odd), model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 40)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score < 0.5 <= by_id[None].score and by_id[900].passages == []
    assert by_id[None].passages[0].stop <= 3
    assert score(edge_rows(spark, []), model).count() == 0


def test_without_both_labels(spark):
    model = fit(edge_rows(spark, [(1, "a b")]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert [r.score < 0.01 for r in score(edge_rows(spark, [(1, "a b"), (2, None)]), model).collect()] == [True, True]
    model = fit(edge_rows(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.weights[0] < 0


def test_query_on_held_out_rows(spark):
    from docflow.llm.queries import QUERIES

    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = QUERIES["op6_toxic_segments"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10_000
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for (a, x), (b, y) in itertools.product(held, held) if x == 1 and y == 0]
    assert np.mean(pairs) > 0.9


def test_scores_and_passages_against_a_plain_version(spark):
    """Log-odds of each word, its maximal segments by their definition, what beats chance, and the logistic of that."""
    source, odds = random.Random(6), np.random.default_rng(6).normal(-0.6, 1.2, BUCKETS).astype(np.float32)
    model = Model(odds, 0.9, 0.15, (-1.0, 0.7, 0.2))
    rows = [(i, " ".join(source.choice(["Ab", "c,", "(d)", "e", "f!", "É", "g-h", "..."]) for _ in range(source.randint(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "ab " * 40)]
    got = {r.doc_id: r for r in score(edge_rows(spark, rows), model).collect()}
    for doc_id, text in rows:
        words_ = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
        bare = ["".join(c.lower() if c.isascii() else c for c in w).strip(string.punctuation) for w in words_]
        scores = [float(odds[zlib.crc32(w.encode()) % BUCKETS]) for w in bare]
        chance = math.log(0.15 * max(len(scores), 1))
        beats = [(a, b, x) for a, b, s in sorted(brute_segments(scores)) if (x := s * 0.9 - chance) > 0]
        z = -1.0 + 0.7 * max((x for *_, x in beats), default=0.0) + 0.2 * sum(x for *_, x in beats)
        assert abs(got[doc_id].score - 1 / (1 + math.exp(-z))) < 1e-5, text
        assert [(p.start, p.stop) for p in got[doc_id].passages] == [(a, b) for a, b, _ in beats]
        assert all(abs(p.score - x) < 1e-4 for p, (*_, x) in zip(got[doc_id].passages, beats))


BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from oracle import session
from docflow.llm.queries import QUERIES
spark = session("2")
try:
    spark.range(1).mapInPandas(lambda parts: (__import__("docflow") for p in parts), "id long").collect()
except Exception as error:
    assert "No module named" in str(error)
else:
    raise SystemExit("workers know the package")
for name in ("op6_toxic_segments", "op8_gru_lm"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
"""


def test_executors_without_the_package(tmp_path):
    """Broadcasts unpack on workers that do not know the package."""
    tests = Path(__file__).resolve().parents[1]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", BARE, str(tests)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
