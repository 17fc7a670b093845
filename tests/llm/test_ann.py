import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import ann
from docflow.llm.ann import _coded, nearest, neighbour_graph


def brute(rows, every=50, k=5):
    """By query id: the ids and cosines of its k nearest."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = unit @ unit[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1), "code": F.lit(2)})


def recall(got, want):
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    return np.mean([len(set(found[q]) & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_small_tables_are_exact(spark):
    source = np.random.default_rng(1)
    rows = [(i, source.standard_normal(8).tolist()) for i in range(400)]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] + [1.0] * 6), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8),
           (None, [1.0] * 8), (1250, [1.0, 2.0]), (1300, [])]
    got = nearest(table(spark, rows + bad)).collect()
    want = brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert {r.query_id for r in got} == set(want)
    for r in got:
        vec_id, score = want[r.query_id][r["rank"] - 1]
        assert r.vec_id == vec_id and abs(r.score - score) < 1e-12


def test_few_and_equal_vectors(spark):
    got = nearest(table(spark, [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 2), (2, 3), (3, 50)]
    assert nearest(table(spark, [])).count() == 0 and nearest(table(spark, [(0, [1.0])])).count() == 0


def test_recall_on_a_large_table_with_copies(spark):
    source = np.random.default_rng(2)
    centres = source.standard_normal((40, 32))
    v = centres[source.integers(0, 40, 9000)] + 0.7 * source.standard_normal((9000, 32))
    v[6000:] = v[0] + 0.05 * source.standard_normal((3000, 32))
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    assert recall(nearest(table(spark, rows)).collect(), brute(rows)) >= 0.9


def test_descent_goes_on_until_settled(spark, monkeypatch):
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(3).standard_normal((200, 6)))]
    coded = _coded(spark.createDataFrame(rows, "id long, v array<double>"))
    calls, changing = [], 5

    def descend(graph, *_):
        calls.append(graph)
        graph = ann._aged(graph)
        return graph.withColumn("fresh", F.unhex(F.repeat(F.lit("01"), F.octet_length("fresh")))) if len(calls) <= changing else graph

    monkeypatch.setattr(ann, "_descend", descend)
    neighbour_graph(coded, part=64, splits=2)
    assert len(calls) == 6
    calls, changing = [], 9
    with pytest.raises(RuntimeError, match="still new"):
        neighbour_graph(coded, part=64, splits=2, rounds=3)


def test_a_round_marks_what_it_found(spark):
    """Old links stay old, links that a round adds are fresh, and nothing is compared where nothing is fresh."""
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(5).standard_normal((300, 6)))]
    coded = _coded(spark.createDataFrame(rows, "id long, v array<double>"))
    graph = ann._merged(ann._within_parts(coded, 300, 8, 32, 1), 300, 8)

    def known(lists):
        return {r.id: {(a, bool(f)) for a, f in zip(np.frombuffer(r.ids, np.int64), np.frombuffer(r.fresh, np.uint8))} for r in lists.collect()}

    before = known(graph)
    after = known(ann._descend(graph, ann._links(graph, 8), coded, 300, 8))
    old = {i: {a for a, _ in links} for i, links in before.items()}
    assert all(f for links in before.values() for _, f in links)
    assert all(f == (a not in old[i]) for i, links in after.items() for a, f in links) and any(f for links in after.values() for _, f in links)
    aged = ann._aged(graph)
    assert known(ann._descend(aged, ann._links(aged, 8), coded, 300, 8)) == {i: {(a, False) for a in links} for i, links in old.items()}


def test_equal_vectors_lose_no_required_neighbour(spark):
    """Two thirds of the rows are equal: their ids are due in order, also to queries among and beside them."""
    source = np.random.default_rng(7)
    v = source.standard_normal((6000, 16))
    v[1999:] = v[1999]
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    got = nearest(table(spark, rows)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(2000, 6000, 50):
        assert found[q] == [i for i in range(1999, 2006) if i != q][:5]
    want = brute([(i, x) for i, x in rows if i < 2000 or i < 2006])
    assert np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / 5 for q in range(0, 2000, 50)]) >= 0.9


def test_query_recall(spark):
    from docflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(QUERIES["op4_nn_descent"](spark, "/root/testdata/sf0.1").collect(), brute(rows)) >= 0.9
