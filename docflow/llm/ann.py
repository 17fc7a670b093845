"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily, both by Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import held, tabled
from docflow.operators.joins import skew_join

#: Neighbours kept per node, and places of the search front; the measured recall rests on both.
NEIGHBOURS, FRONT = 32, 64
REVERSE = 16
#: Random splits that the graph starts from, and nodes of a part.
SPLITS, PART = 16, 1024
#: Descent ends when a smaller share of all links is new; not to settle within so many rounds is an error.
ROUNDS, SETTLED = 40, 0.05
#: Pairs that one centre proposes per member and round.
PROPOSED = 4
#: Of each query's front, so many are compared exactly.
CHECKED = 32
TASK_ROWS = 20_000
LISTS = "id long, ids binary, scores binary, fresh binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `v` (array of double) of the rows that take part.

    Left out are null ids, and vectors that are null, empty, zero, of another
    length than most, or hold a null or non-finite number. Of rows with one id
    that with the smallest vector hash counts.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (common.n if common else 0))
    return rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def _coded(rows: DataFrame) -> DataFrame:
    """Unit vectors in sixteen bits a number, behind their scale; exact enough to choose whom to compare exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            scale = (np.abs(unit).max(axis=1, keepdims=True) / 32767).astype(np.float32)
            codes = np.clip(np.rint(unit / scale), -32767, 32767).astype(np.int16)
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() + c.tobytes() for s, c in zip(scale, codes)], pa.binary())],
                                  names=["id", "code"])

    return rows.select("id", "v").mapInArrow(run, "id long, code binary")


def _decode(codes) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].copy().view(np.int16).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _lists(ids: np.ndarray, links: list[np.ndarray], scores: list[np.ndarray], fresh: list[np.ndarray] | None = None) -> pd.DataFrame:
    """Lists of links and their scores; `fresh` marks links that were found in the last round, all if not given."""
    fresh = [np.ones(len(x), np.uint8) for x in links] if fresh is None else fresh
    return pd.DataFrame({"id": ids, "ids": [x.astype(np.int64).tobytes() for x in links],
                         "scores": [x.astype(np.float32).tobytes() for x in scores], "fresh": [x.astype(np.uint8).tobytes() for x in fresh]})


def _within_parts(coded: DataFrame, n: int, neighbours: int, part: int, splits: int) -> DataFrame:
    """First lists: the nearest of each node within parts that random planes through the mean cut out."""
    bits = max(0, round(np.log2(max(n, 1) / part)))
    first = coded.first()
    width = (len(first.code) - 4) // 2
    mean = np.zeros(width)
    if bits:
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.record_batch([pa.array([_decode(batch.column(1).to_pylist()).sum(axis=0, dtype=np.float64).tolist()])], names=["s"])

        sums = coded.mapInArrow(total, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        mean[[r.pos for r in sums]] = [r.s / n for r in sums]
    planes = np.random.default_rng(1).standard_normal((width, splits * max(bits, 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = ((_decode(batch.column(1).to_pylist()) - mean) @ planes > 0).reshape(batch.num_rows, splits, -1)
            key = side[:, :, :bits] @ (1 << np.arange(bits, dtype=np.int64))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), splits))
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows),
                                   pa.array(np.tile(np.arange(splits, dtype=np.int32), batch.num_rows)), pa.array(key.astype(np.int64).ravel())],
                                  names=["id", "code", "split", "key"])

    dealt = coded.mapInArrow(deal, "id long, code binary, split int, key long")
    sizes = dealt.groupBy("split", "key").agg(F.ceil(F.count("*") / (2 * part)).alias("cuts"))
    dealt = dealt.join(sizes, ["split", "key"]).withColumn("cut", F.pmod(F.xxhash64("id", "split"), "cuts"))

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        ids, v = rows["id"].to_numpy(), _decode(rows["code"].tolist())
        near = v @ v.T
        np.fill_diagonal(near, -np.inf)
        k = min(neighbours // 2, len(ids) - 1)
        best = np.argpartition(-near, max(k - 1, 0), axis=1)[:, :k]
        return _lists(ids, list(ids[best]), list(np.take_along_axis(near, best, axis=1)))

    return dealt.groupBy("split", "key", "cut").applyInPandas(nearest, LISTS)


def _merged(lists: DataFrame, rows: int, neighbours: int) -> DataFrame:
    """The best `neighbours` different links of each node from all its lists, best first, ties to the smaller id.

    A link that comes more than once keeps its oldest mark.
    """
    def best(part: pd.DataFrame) -> pd.DataFrame:
        owners = np.repeat(part["id"].to_numpy(), [len(x) // 8 for x in part["ids"]])
        links = np.frombuffer(b"".join(part["ids"]), np.int64)
        scores = np.frombuffer(b"".join(part["scores"]), np.float32)
        fresh = np.frombuffer(b"".join(part["fresh"]), np.uint8)
        order = np.lexsort((-scores, fresh, links, owners))
        owners, links, scores, fresh = owners[order], links[order], scores[order], fresh[order]
        new = (links != owners) & np.concatenate([[True], (owners[1:] != owners[:-1]) | (links[1:] != links[:-1])])
        owners, links, scores, fresh = owners[new], links[new], scores[new], fresh[new]
        order = np.lexsort((links, -scores, owners))
        owners, links, scores, fresh = owners[order], links[order], scores[order], fresh[order]
        ids, first = np.unique(owners, return_index=True)
        bounds = np.concatenate([first, [len(owners)]])
        ends = np.minimum(bounds[1:], bounds[:-1] + neighbours)
        lone = np.setdiff1d(part["id"].to_numpy(), ids)
        cut = [[x[a:b] for a, b in zip(bounds, ends)] for x in (links, scores, fresh)]
        return pd.concat([_lists(ids, *cut), _lists(lone, [np.zeros(0)] * len(lone), [np.zeros(0)] * len(lone))])

    bins = max(4, rows // TASK_ROWS)
    return lists.groupBy(F.pmod(F.xxhash64("id"), F.lit(bins)).alias("_bin")).applyInPandas(best, LISTS)


def _links(graph: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row per link: `id`, `to`, `score`, whether it is `fresh`, and `least`, the score of the node's last link; -2 if its list has room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links, scores, fresh = (batch.column(i).to_pylist() for i in range(4))
            sizes = np.array([len(x) // 8 for x in links], np.int64)
            flat = np.frombuffer(b"".join(scores), np.float32)
            least = np.repeat([flat[e - 1] if n >= neighbours else -2.0 for n, e in zip(sizes, np.cumsum(sizes))], sizes).astype(np.float32)
            yield pa.record_batch([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.frombuffer(b"".join(links), np.int64)),
                                   pa.array(flat), pa.array(least), pa.array(np.frombuffer(b"".join(fresh), np.uint8) > 0)],
                                  names=["id", "to", "score", "least", "fresh"])

    return graph.mapInArrow(run, "id long, to long, score float, least float, fresh boolean")


def _aged(graph: DataFrame) -> DataFrame:
    """The same lists without a fresh link."""
    return graph.withColumn("fresh", F.unhex(F.repeat(F.lit("00"), F.octet_length("fresh"))))


def _descend(graph: DataFrame, links: DataFrame, coded: DataFrame, n: int, neighbours: int) -> DataFrame:
    """One round: the links of each node, and some of those to it, get to know each other.

    Two old links of a node have met in an earlier round, so only pairs with a
    fresh one are compared, and only nodes that have a fresh one take part.
    """
    some = W.partitionBy("to").orderBy(F.desc("fresh"), F.xxhash64("id", "to"))
    # A node that very many link to is known to `REVERSE` of them at a time, fresh ones first, as the method samples them.
    part = W.partitionBy("to", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy(F.desc("fresh"), F.xxhash64("id", "to"))
    back = links.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= REVERSE)
    back = back.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= REVERSE)
    pairs = links.select(F.col("id").alias("centre"), F.col("to").alias("member"), "fresh").union(
        back.select(F.col("to").alias("centre"), F.col("id").alias("member"), "fresh"))
    pairs = pairs.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    busy = pairs.filter("fresh").select("centre").distinct()
    own = links.groupBy("id").agg(F.first("least").alias("least"))
    known = coded.join(own, "id", "left").select(F.col("id").alias("member"), "code", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
    members = pairs.join(busy, "centre", "left_semi").join(known, "member")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("centre", kind="stable")
        centres, ids, least = rows["centre"].to_numpy(), rows["member"].to_numpy(), rows["least"].to_numpy(np.float32)
        old, v = ~rows["fresh"].to_numpy(bool), _decode(rows["code"].tolist())
        bounds = np.flatnonzero(np.concatenate([[True], centres[1:] != centres[:-1], [True]]))
        out_ids, out_links, out_scores = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            near = v[a:b] @ v[a:b].T
            near[np.ix_(old[a:b], old[a:b])] = -np.inf
            np.fill_diagonal(near, -np.inf)
            k = min(PROPOSED, b - a - 1)
            if k < 1:
                continue
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            scores = np.take_along_axis(near, best, axis=1)
            for i in np.flatnonzero(scores.max(axis=1) > least[a:b]):
                good = scores[i] > least[a + i]
                out_ids.append(ids[a + i])
                out_links.append(ids[a:b][best[i][good]])
                out_scores.append(scores[i][good])
        return _lists(np.array(out_ids, np.int64), out_links, out_scores)

    bins = max(4, n * (neighbours + REVERSE) // TASK_ROWS)
    found = members.groupBy(F.pmod(F.xxhash64("centre"), F.lit(bins)).alias("_bin")).applyInPandas(meet, LISTS)
    return held(_merged(_aged(graph).union(found), n * PROPOSED, neighbours))


def neighbour_graph(coded: DataFrame, neighbours: int = NEIGHBOURS, part: int = PART, splits: int = SPLITS, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: per node the ids of its best known neighbours, their scores, and which the last round found.

    Lists start from the parts of random splits (crowded parts are cut by a
    hash), and each round compares neighbours of a common node, until few links
    are new. Fails if they have not settled after `rounds`.
    """
    n = coded.count()
    graph = held(_merged(_within_parts(coded, n, neighbours, part, splits), n * splits // 4, neighbours))
    for _ in range(rounds):
        links = held(_links(graph, neighbours))
        graph = _descend(graph, links, coded, n, neighbours)
        fresh, total = graph.agg(F.sum(F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2), F.sum(F.octet_length("fresh"))).first()
        if (fresh or 0) <= SETTLED * (total or 0):
            return graph
    raise RuntimeError(f"{fresh:.0f} of {total} links are still new after {rounds} rounds")


def search(graph: DataFrame, coded: DataFrame, queries: DataFrame, front: int = FRONT, checked: int = CHECKED) -> DataFrame:
    """`query_id`, `vec_id`: the best `checked` nodes that a greedy walk from each query's own node meets.

    Each step looks at the neighbours of the best `front` nodes that were not
    looked at yet, scores those not met before, and ends for a query when its
    front has nothing new.
    """
    links = held(_links(graph).select("id", "to"))  # whatever their marks
    known = queries.join(coded, F.col("query_id") == F.col("id")).select("query_id", F.col("code").alias("query_code"))
    step = queries.select("query_id", F.col("query_id").alias("id"))
    met = held(step)
    pool = None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_decode(batch.column(2).to_pylist()) * _decode(batch.column(3).to_pylist())).sum(axis=1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near.astype(np.float32))], names=["query_id", "id", "score"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    while True:
        new = step.join(links, "id").select("query_id", F.col("to").alias("id")).distinct().join(met, ["query_id", "id"], "left_anti")
        rows = new.join(coded, "id").join(known, "query_id").select("query_id", "id", "code", "query_code")
        scored = held(rows.mapInArrow(compare, "query_id long, id long, score float").withColumn("seen", F.lit(False)))
        met = met.union(scored.select("query_id", "id"))
        pool = scored if pool is None else scored.union(pool)
        pool = held(pool.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= front).drop("_r"))
        step = pool.filter("not seen").select("query_id", "id")
        if not step.limit(1).count():
            break
        pool = pool.withColumn("seen", F.lit(True))
    return pool.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= checked).select("query_id", F.col("id").alias("vec_id"))


def _copies(rows: DataFrame, keep: int) -> DataFrame:
    """`_h1`, `_h2` (128 bits of the vector), `rep`, `id`: of rows with equal vectors the `keep` smallest ids, `rep` being the smallest.

    Equal vectors may be a large share of all, so the smallest of each salt are taken first.
    """
    few = _hashed(rows).select("id", "_h1", "_h2")
    for key in (["_h1", "_h2", F.pmod(F.xxhash64("id"), F.lit(64))], ["_h1", "_h2"]):
        few = few.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("id"))).filter(F.col("_r") <= keep).drop("_r")
    return few.select("_h1", "_h2", F.min("id").over(W.partitionBy("_h1", "_h2")).alias("rep"), "id")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_h1": F.xxhash64("v"), "_h2": F.xxhash64(F.lit(3), "v")})


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (query_id, vec_id) with the cosine of their vectors in double precision."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.asarray(batch.column(i).flatten()).reshape(batch.num_rows, -1) for i in (2, 3))
                a, b = (x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))) for x in (a, b))
                score = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    both = pairs.join(vectors.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(
        vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return both.select("query_id", "vec_id", "v", "q").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query by cosine: `query_id`, `rank` from 1, `vec_id`, `score`.

    Queries are the rows whose id is divisible by `every`, candidates all rows
    but the query's own. Scores are cosines in double precision of the vectors
    as given; ties go to the smaller id. `usable` says which rows take part.
    With k candidates or fewer, all are returned.

    The graph holds each different vector once. Rows with equal vectors have
    the same scores, so of each only the k + 1 smallest ids can be returned:
    the walk finds vectors, and these are replaced by their ids at the end.
    """
    rows = tabled(usable(vectors, id_col, vector_col), "vectors")
    copies = tabled(_copies(rows, k + 1), "copies")
    different = tabled(rows.join(copies.filter("id = rep").select("id"), "id", "left_semi"), "different")
    coded = tabled(_coded(different), "codes")
    one = copies.filter("id = rep").select(F.xxhash64("_h1", "_h2").alias("_g"), "rep")
    asked = _hashed(rows.filter(F.col("id") % every == 0)).select(F.col("id").alias("query_id"), F.xxhash64("_h1", "_h2").alias("_g"))
    asked = tabled(skew_join(asked, one, "_g").select("query_id", "rep"), "asked")
    walkers = asked.select(F.col("rep").alias("query_id")).distinct()
    own = walkers.withColumn("vec_id", F.col("query_id"))
    found = own.union(search(neighbour_graph(coded), coded, walkers)) if coded.limit(2).count() > 1 else own
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = _exact(found, different).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")
    ids = best.join(copies.select(F.col("rep").alias("vec_id"), "id"), "vec_id").select("query_id", "score", F.col("id").alias("vec_id"))
    ids = ids.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    lists = ids.groupBy(F.col("query_id").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("_found"))
    others = F.slice(F.filter("_found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return skew_join(asked, lists, "rep").select("query_id", F.posexplode(others).alias("_no", "_x")).select(
        "query_id", (F.col("_no") + 1).alias("rank"), "_x.vec_id", "_x.score")


@query("op4_nn_descent")
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
