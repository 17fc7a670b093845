"""Exact similarity top-k, without ever pairing rows in the plan.

Questions are written to the shared folder, and each task that scans nodes
reads them from there in blocks; none of them passes through the driver. A
block of nodes meets a block of questions as two matrices. A task knows the k
best scores it has found, so it leaves out questions that no node of a block
can reach, and hits that are not among the k best; what is shuffled is k hits
per question and block of nodes at most.

Scores are compared after rounding to `SCORE_DIGITS`; equal ones go by node id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docflow.session import task_files, work_path

METRICS = ("cosine", "l2", "dot")
SCORE_DIGITS = 12
#: Bytes of question vectors that meet the nodes at once, of node rows that meet them, and of best scores a task keeps.
BATCH_BYTES, NODE_BYTES, FLOOR_BYTES = 32 << 20, 8 << 20, 64 << 20
TILE = 256


def _matrix(column) -> np.ndarray:
    """An Arrow list<double> column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist())}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _ids(column) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.asarray(column.to_pylist(), dtype=str)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _rough(q, m, metric):
    """Scores by matrix product, larger is better; good enough to choose candidates."""
    if metric == "l2":
        sq = (np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", m, m)[None, :] - 2 * (q @ m.T))
        return -np.maximum(sq, 0.0)
    scores = q @ m.T
    if metric == "cosine":
        lengths = _norms(q)[:, None] * _norms(m)[None, :]
        scores = np.divide(scores, lengths, out=np.zeros_like(scores), where=lengths > 0)
    return scores


def _magnitude(q, m, metric):
    """Size per question of the numbers `_rough` subtracts from each other, which its error grows with."""
    if metric == "cosine":
        return np.ones(len(q))
    largest = _norms(m).max()
    return _norms(q) ** 2 + largest ** 2 if metric == "l2" else _norms(q) * largest


def _final(q, m, metric):
    """Scores row by row, the same for equal vectors wherever they lie."""
    if metric == "l2":
        return np.round(_norms(q - m), SCORE_DIGITS) + 0.0
    scores = np.einsum("ij,ij->i", q, m)
    if metric == "cosine":
        lengths = _norms(q) * _norms(m)
        scores = np.divide(scores, lengths, out=np.zeros_like(scores), where=lengths > 0)
    return np.round(scores, SCORE_DIGITS) + 0.0


def _best(qi, ids, scores, k, metric):
    """Positions of the k best per question, ordered by question, score and id."""
    order = np.lexsort((ids, scores if metric == "l2" else -scores, qi))
    group = qi[order]
    first = np.searchsorted(group, group, side="left")
    return order[np.arange(len(order)) - first < k]


def _without_idle_copies(ids, m, k):
    """Positions of all nodes but those with k copies of smaller id in the block: they can be in no best k."""
    mark = np.einsum("ij,j->i", m, np.sqrt(np.arange(2.0, m.shape[1] + 2)))
    order = np.lexsort((ids, mark))
    group = mark[order]
    first = np.searchsorted(group, group, side="left")
    idle = np.flatnonzero(np.arange(len(order)) - first >= k)
    # Equal marks only suggest equal vectors, so look at the k nodes before each one.
    for back in range(1, k + 1):
        idle = idle[(m[order[idle]] == m[order[idle - back]]).all(axis=1)]
    keep = np.ones(len(order), dtype=bool)
    keep[order[idle]] = False
    return np.flatnonzero(keep)


class _BestHits:
    """The best k nodes per question among the blocks seen so far."""

    def __init__(self, labels, q, k, metric, schema: pa.Schema):
        self.labels, self.q, self.k, self.metric, self.schema = labels, q, k, metric, schema
        self.found = None  # question number, node id, score, position in `carried`
        self.carried = None

    def add(self, ids, m, carried) -> None:
        """Fold in a block of nodes: ids, their vectors and the rows of the carried columns."""
        if not len(ids) or not len(self.q):
            return
        kept = _without_idle_copies(ids, m, self.k)
        if len(kept) < len(ids):
            ids, m, carried = ids[kept], m[kept], carried.take(pa.array(kept))
        seen = 0 if self.found is None else len(self.found[0])
        found = [] if self.found is None else [self.found]
        for start in range(0, len(self.q), TILE):
            tile = self.q[start:start + TILE]
            rough = _rough(tile, m, self.metric)
            if len(ids) > self.k:
                cut = np.partition(rough, -self.k, axis=1)[:, -self.k]
                slack = 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1)) + 1e-11 * _magnitude(tile, m, self.metric)
                ti, ni = np.nonzero(rough >= (cut - slack)[:, None])
            else:
                ti, ni = (a.ravel() for a in np.indices(rough.shape))
            scores = _final(tile[ti], m[ni], self.metric)
            keep = _best(ti, ids[ni], scores, self.k, self.metric)
            found.append((ti[keep] + start, ids[ni][keep], scores[keep], ni[keep] + seen))
        qi, node, score, position = (np.concatenate(parts) for parts in zip(*found))
        keep = _best(qi, node, score, self.k, self.metric)
        rows = carried if self.carried is None else pa.concat_tables([self.carried, carried])
        self.carried = rows.take(pa.array(position[keep]))
        self.found = qi[keep], node[keep], score[keep], np.arange(len(keep))

    def table(self) -> pa.Table:
        if self.found is None:
            return self.schema.empty_table()
        qi, node, score, _ = self.found
        columns = [pa.array(self.labels[qi].tolist(), self.schema.field(0).type),
                   pa.array(node.tolist(), self.schema.field(1).type), pa.array(score)]
        carried = [self.carried.column(f.name).cast(f.type) for f in list(self.schema)[3:]]
        return pa.Table.from_arrays([*columns, *carried], schema=self.schema)


def _plain(df: DataFrame, id_col: str, vector: str, name: str, carry=()) -> DataFrame:
    return df.select(F.col(id_col).alias(name), F.col(vector).cast("array<double>").alias("vector"), *carry)


def _hit_schema(asked: DataFrame, held: DataFrame, carry) -> T.StructType:
    return T.StructType([asked.schema["query_id"], held.schema["node_id"], T.StructField("score", T.DoubleType()),
                         *[held.schema[c] for c in carry]])


def _usable(table):
    """Rows with an id and a vector of numbers. Testing it here spares the plan a second run of the vector expression."""
    table = table.filter(pc.and_(pc.is_valid(table.column(0)), pc.is_valid(table.column("vector"))))
    finite = np.isfinite(_matrix(table.column("vector"))).all(axis=1)
    return table if finite.all() else table.filter(pa.array(finite))


def _rank(hits: DataFrame, k: int, metric: str) -> DataFrame:
    better = F.asc("score") if metric == "l2" else F.desc("score")
    place = W.partitionBy("query_id").orderBy(better, F.asc("node_id"))
    carried = [c for c in hits.columns if c not in ("query_id", "node_id", "score")]
    return (hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "node_id", "score", *carried))


def _check(k: int, metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if k < 1:
        raise ValueError("need k >= 1")


def top_k(queries: DataFrame, nodes: DataFrame, k: int = 2, metric: str = "cosine", *, query_id: str = "query_id",
          query_vector: str = "embedding", node_id: str = "node_id", node_vector: str = "embedding",
          carry: list[str] = (), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Exact k best nodes per question: (query_id, rank, node_id, score) and the `carry` columns of the node.

    `score` is the cosine, the dot product or, for `l2`, the distance. Under
    cosine a question whose vector is zero has no hits. All vectors must have
    one length. The nodes are scanned once, whatever the number of questions;
    these are written to the shared folder, and tasks read them from there in
    blocks of about `batch_bytes`.
    """
    _check(k, metric)
    spark = queries.sparkSession
    path = work_path(spark, "questions")
    asked = _plain(queries, query_id, query_vector, "query_id").filter("query_id IS NOT NULL AND vector IS NOT NULL")
    asked.write.parquet(path)
    least, length = spark.read.schema(asked.schema).parquet(path).agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != length:
        raise ValueError(f"vectors of different lengths: {least} to {length}")
    held = _plain(nodes, node_id, node_vector, "node_id", carry)
    schema = _hit_schema(asked, held, carry)
    if length is None:
        return _rank(spark.createDataFrame([], schema), k, metric)
    return _rank(_scan(path, max(1, batch_bytes // (8 * length + 64)), held, schema, k, metric), k, metric)


def _question_blocks(path: str, rows: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and vectors of the written questions, so many at a time."""
    system, place = task_files(path)
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows):
                head = _usable(pa.Table.from_batches([batch]))
                if metric == "cosine" and head.num_rows:
                    head = head.filter(pa.array(_norms(_matrix(head.column("vector"))) > 0))
                if head.num_rows:
                    yield np.asarray(head.column(0).to_pylist()), _matrix(head.column("vector"))


class _Questions:
    """The blocks of all questions, kept in memory if they are no more than one block's rows."""

    def __init__(self, path: str, rows: int, metric: str):
        self.source, self.kept, self.rows = (path, rows, metric), None, rows

    def __iter__(self):
        if self.kept is not None:
            return iter(self.kept)
        return self._read()

    def _read(self):
        small: list | None = []
        for block in _question_blocks(*self.source):
            if small is not None:
                small = [*small, block] if sum(len(q) for _, q in small) + len(block[1]) <= self.rows else None
            yield block
        self.kept = small


def _node_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """A task's nodes in tables of about `size` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _reach(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Per question a score that no node of the block can beat: the nodes lie in a ball around their mean."""
    if metric == "cosine":
        lengths = _norms(m)[:, None]
        m, q = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0), q / _norms(q)[:, None]
    centre = m.mean(axis=0)
    radius = _norms(m - centre).max()
    if metric == "l2":
        return np.maximum(_norms(q - centre) - radius, 0.0)
    return q @ centre + _norms(q) * radius


class _Floor:
    """The k best scores that a task has found per question so far, for blocks of questions up to `FLOOR_BYTES`."""

    def __init__(self, k: int, metric: str):
        self.k, self.sign, self.scores, self.left = k, -1.0 if metric == "l2" else 1.0, {}, FLOOR_BYTES // (8 * k)

    def least(self, number: int, questions: int) -> np.ndarray:
        """What a new hit has to reach, larger is better."""
        held = self.scores.get(number)
        return held[:, 0] if held is not None else np.full(questions, -np.inf)

    def add(self, number: int, questions: int, at: np.ndarray, scores: np.ndarray) -> None:
        """Hits of a block of questions: the question's place and the score, at most k of each."""
        held = self.scores.get(number)
        if held is None:
            if questions > self.left:
                return
            self.left -= questions
            held = self.scores[number] = np.full((questions, self.k), -np.inf)
        new = np.full(held.shape, -np.inf)
        order = np.argsort(at, kind="stable")
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order], "left")
        new[at[order], place] = self.sign * scores[order]
        both = np.concatenate([held, new], axis=1)
        held[:] = np.sort(both, axis=1)[:, -self.k:]


def _scan(path: str, rows: int, held: DataFrame, schema: T.StructType, k: int, metric: str) -> DataFrame:
    """The k best nodes per question of each block of nodes, without those that the task knows k better ones of."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, floor = _Questions(path, rows, metric), _Floor(k, metric)
        for table in _node_blocks(batches, NODE_BYTES):
            table = _usable(table)
            if not table.num_rows:
                continue
            ids, m, carried = _ids(table.column(0)), _matrix(table.column("vector")), table.select(arrow.names[3:])
            for number, (labels, q) in enumerate(questions):
                least, reach = floor.least(number, len(q)), floor.sign * _reach(q, m, metric)
                # A bound that falls short by no more than rounding may still be reached.
                slack = 1e-9 * np.maximum(1.0, np.abs(reach)) + 1e-9 * _magnitude(q, m, metric)
                able = np.flatnonzero(reach + slack >= least)
                if not len(able):
                    continue
                best = _BestHits(labels[able], q[able], k, metric, arrow)
                best.add(ids, m, carried)
                if best.found is None:
                    continue
                at, scores = able[best.found[0]], best.found[2]
                found = best.table().filter(pa.array(floor.sign * scores >= least[at]))
                floor.add(number, len(q), at, scores)
                yield from found.combine_chunks().to_batches()

    return held.mapInArrow(run, schema)
