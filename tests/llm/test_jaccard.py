import random

import numpy as np
from brute import edge_rows, words
from pyspark.sql import Row, functions as F

from docflow.llm.jaccard import BLOCK, HASHES, STEP, THRESHOLD, least_matches, near_classes, one_of_each


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def expected(rows):
    """By row: class id and number of links to other shingle sets."""
    sets = [shingles(t) for _, t in rows]
    nodes = list({s for s in sets if s})
    linked = {s: [t for t in nodes if t != s and len(s & t) >= THRESHOLD * len(s | t) - 1e-9] for s in nodes}
    group = {}
    for s in nodes:
        if s not in group:
            todo, members = [s], set()
            while todo:
                x = todo.pop()
                if x not in members:
                    members.add(x)
                    todo += linked[x]
            group |= dict.fromkeys(members, frozenset(members))
    out = []
    for (i, _), s in zip(rows, sets):
        ids = [j for (j, _), t in zip(rows, sets) if t in group[s]] if s else [i]
        out.append((i, min((j for j in ids if j is not None), default=None), len(linked[s]) if s else 0))
    return sorted(out, key=repr)


def near_rows():
    source, rows = random.Random(5), []
    for base in range(30):
        text = words(base, source.choice([3, 6, 30, 120, 400]))
        for _ in range(source.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(source.randint(0, 4)):
                copy[source.randrange(len(copy))] = "new%d" % source.randrange(99)
            rows.append((len(rows), source.choice([" ", "\n", "  "]).join(copy)))
    return rows


def test_against_brute_force(spark):
    rows = near_rows() + [(None, "a b c d e f"), (1000, "A b c d e f"), (1001, None), (1002, ""), (1003, " \n"), (1004, "one two"),
                          (1005, "One  two"), (1005, "One  two"), (None, "alone here"), (1006, "z " * 60_000), (1007, "z " * 50_000)]
    got = near_classes(edge_rows(spark, rows)).collect()
    assert sorted(((r._id, r.class_id, r.n_links) for r in got), key=repr) == expected(rows)
    kept = one_of_each(edge_rows(spark, rows)).collect()
    classes = {}
    for i, (j, t) in enumerate(rows):
        classes.setdefault(shingles(t) or (j, t), []).append(j)
    want = {r.class_id for r in got}
    assert {r.doc_id for r in kept} == want and kept[0].score == 2.0
    assert near_classes(edge_rows(spark, [])).count() == 0


def test_one_large_group_in_blocks(spark):
    text = words(1, 300)
    rows = [(i, " ".join(text[:i % 290] + ["w%d" % i] + text[i % 290 + 1:])) for i in range(2 * BLOCK + 40)]
    got = near_classes(edge_rows(spark, rows))
    assert [tuple(r) for r in got.groupBy("class_id", "n_links").count().collect()] == [(0, len(rows) - 1, len(rows))]


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches()
    source = np.random.default_rng(1)
    hits = source.random((20_000, HASHES)) < THRESHOLD
    lost = np.zeros(len(hits), bool)
    for n in range(STEP, HASHES + 1, STEP):
        lost |= hits[:, :n].sum(axis=1) < least[n]
    assert lost.mean() < 1e-3 and least[HASHES] > 0.5 * HASHES


def test_query(spark):
    from docflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_ngram_jaccard"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_one_of_each_keeps_the_callers_columns(spark):
    text = " ".join(words(1, 40))
    docs = edge_rows(spark, [(2, text), (1, text), (1, text), (None, "else"), (3, None)]).withColumns({"_r2": F.lit(5), "_id": F.lit("own"), "_row": F.lit(0)})
    out = one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.select("doc_id", "text", "_r1", "_r2", "_id", "_row").collect())) == sorted(map(repr, [
        Row(doc_id=i, text=t, _r1="x", _r2=5, _id="own", _row=0) for i, t in ((1, text), (None, "else"), (3, None))]))
