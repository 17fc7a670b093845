import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions.vectors import l2_normalise
from docflow.operators import similarity
from docflow.operators.similarity import top_k


def vectors(spark, matrix, name, ids=None):
    ids = list(range(len(matrix))) if ids is None else ids
    kind = "string" if ids and isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, matrix)],
                                 f"{name} {kind}, embedding array<double>").repartition(5)


def brute(queries, nodes, k, metric, ids=None):
    ids = list(range(len(nodes))) if ids is None else ids
    out = []
    for q, a in enumerate(queries):
        if metric == "cosine" and not a.any():
            continue
        if metric == "l2":
            s = np.sqrt(((nodes - a) ** 2).sum(1))
            sign = 1
        else:
            s = nodes @ a
            sign = -1
            if metric == "cosine":
                n = np.linalg.norm(nodes, axis=1) * np.linalg.norm(a)
                s = np.divide(s, n, out=np.zeros(len(nodes)), where=n > 0)
        s = np.round(s, 12)
        order = sorted(range(len(nodes)), key=lambda i: (sign * s[i], ids[i]))[:k]
        out += [(q, r + 1, ids[i], round(float(s[i]) + 0.0, 9)) for r, i in enumerate(order)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.node_id, round(r.score + 0.0, 9)) for r in df.collect())


def data(seed=3, n=400, d=6, q=7):
    rng = np.random.default_rng(seed)
    nodes = np.round(rng.normal(size=(n, d)) * (1 + rng.integers(0, 4, size=(n, 1))), 3)
    nodes[: n // 3] = nodes[0]          # a third of the nodes are copies of one
    nodes[n - 2] = 0.0                  # a zero vector
    queries = np.vstack([nodes[0], np.zeros(d), np.round(rng.normal(size=(q, d)), 3)])
    return queries, nodes


@pytest.mark.parametrize("metric", similarity.METRICS)
@pytest.mark.parametrize("batch_bytes, k", [(similarity.BATCH_BYTES, 1), (similarity.BATCH_BYTES, 3), (250, 3)])
def test_exact_in_one_and_in_many_batches(spark, metric, batch_bytes, k):
    queries, nodes = data()
    found = top_k(vectors(spark, queries, "query_id"), vectors(spark, nodes, "node_id"), k, metric, batch_bytes=batch_bytes)
    assert got(found) == brute(queries, nodes, k, metric)


@pytest.mark.parametrize("batch_bytes", [similarity.BATCH_BYTES, 250])
def test_close_vectors_far_from_the_origin(spark, batch_bytes):
    queries, nodes = data()
    queries, nodes = queries / 1000 + 30_000, nodes / 1000 + 30_000
    found = top_k(vectors(spark, queries, "query_id"), vectors(spark, nodes, "node_id"), 3, "l2", batch_bytes=batch_bytes)
    assert got(found) == brute(queries, nodes, 3, "l2")


def test_no_block_of_questions_is_over_the_bound(spark, folder):
    """All questions come in blocks of so many; those that cannot be compared are in none."""
    asked = vectors(spark, np.ones((300, 500)), "query_id").withColumnRenamed("embedding", "vector")
    bad = spark.createDataFrame([(1000, [0.0] * 500), (1001, [float("nan")] * 500)], "query_id long, vector array<double>")
    asked.union(bad).write.parquet(f"{folder}/asked")
    blocks = list(similarity._question_blocks(f"file:{folder}/asked", 24, "cosine"))
    assert max(len(labels) for labels, _ in blocks) <= 24 and all(q.nbytes <= 24 * 500 * 8 for _, q in blocks)
    assert sorted(label for labels, _ in blocks for label in labels.tolist()) == list(range(300))


def test_vectors_of_different_lengths_are_refused(spark):
    ragged = spark.createDataFrame([(0, [1.0] * 3), (1, [1.0] * 5)], "query_id long, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        top_k(ragged, ragged.withColumnRenamed("query_id", "node_id"), 1)


def test_only_copies_that_cannot_win_are_left_out():
    m = np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]] * 2)
    assert similarity._without_idle_copies(np.array([9, 5, 7, 1, 3, 0, 2]), m, 2).tolist() == [3, 4, 5, 6]
    mixed = np.array([[1.0, 2.0], [3.0, 4.0]] * 3)
    assert similarity._without_idle_copies(np.arange(6), mixed, 1).tolist() == [0, 1]
    assert similarity._without_idle_copies(np.array(["b", "a"]), np.ones((2, 3)), 1).tolist() == [1]


def test_string_ids_nulls_and_carried_columns(spark):
    queries, nodes = data(n=50)
    ids = [f"n{i:03d}" for i in range(50)]
    held = vectors(spark, nodes, "node_id", ids).withColumn("tag", F.concat(F.lit("t"), "node_id")).unionByName(
        spark.createDataFrame(
            [(None, [1.0] * 6, "x"), ("zz", None, "x"), ("nan", [float("nan")] * 6, "x"), ("inf", [float("inf")] * 6, "x"),
             ("gap", [1.0] * 5 + [None], "x")], "node_id string, embedding array<double>, tag string"))
    for bound in (similarity.BATCH_BYTES, 1):
        found = top_k(vectors(spark, queries, "query_id"), held, 2, carry=["tag"], batch_bytes=bound)
        assert got(found) == brute(queries, nodes, 2, "cosine", ids)
        assert all(r.tag == "t" + r.node_id for r in found.collect())


def test_fewer_nodes_than_asked_for_and_no_nodes(spark):
    nodes = np.array([[1.0, 0.0], [0.0, 1.0]])
    asked = vectors(spark, nodes, "query_id")
    assert top_k(asked, vectors(spark, nodes, "node_id"), 5).count() == 4
    assert top_k(asked, vectors(spark, nodes, "node_id"), 5, batch_bytes=1).count() == 4
    for bound in (similarity.BATCH_BYTES, 1):
        assert top_k(asked, vectors(spark, nodes, "node_id").limit(0), 5, batch_bytes=bound).count() == 0
        assert top_k(asked.limit(0), vectors(spark, nodes, "node_id"), 5, batch_bytes=bound).count() == 0


def test_arguments_are_checked(spark):
    asked = vectors(spark, np.eye(2), "query_id")
    with pytest.raises(ValueError):
        top_k(asked, asked.withColumnRenamed("query_id", "node_id"), 2, "manhattan")
    with pytest.raises(ValueError):
        top_k(asked, asked.withColumnRenamed("query_id", "node_id"), 0)


def test_normalised_vectors(spark):
    rows = vectors(spark, np.array([[3.0, 4.0], [0.0, 0.0]]), "id").select("id", l2_normalise(F.col("embedding")).alias("v"))
    assert {r.id: r.v for r in rows.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0]}


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_questions_never_reach_the_driver_and_nodes_are_scanned_once(spark, folder, metric, monkeypatch):
    """Many blocks of questions against many blocks of nodes, some of them out of reach of all questions."""
    rng = np.random.default_rng(5)
    nodes = np.concatenate([rng.normal(size=(300, 4)) + 50, rng.normal(size=(300, 4)), np.zeros((2, 4))])
    queries = rng.normal(size=(200, 4))
    vectors(spark, nodes, "node_id").repartition(2).write.parquet(f"{folder}/nodes")
    asked = vectors(spark, queries, "query_id")
    kind = type(asked)
    collect = kind.collect

    def one_row(df):
        rows = collect(df)
        assert len(rows) <= 1, "questions on the driver"
        return rows

    with monkeypatch.context() as patch:
        for name in ("toArrow", "toPandas"):
            patch.setattr(kind, name, lambda *_, **__: pytest.fail("rows on the driver"))
        patch.setattr(kind, "collect", one_row)
        patch.setattr(similarity, "NODE_BYTES", 1 << 12)
        found = top_k(asked, spark.read.parquet(f"{folder}/nodes"), 3, metric, batch_bytes=600)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert got(found) == brute(queries, nodes, 3, metric)
