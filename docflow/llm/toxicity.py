"""Toxic passages as maximum-scoring segments of token log-odds, and documents scored by how unlikely theirs are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.words import by_bytes, crcs, strings, thrifty, word_codes
from docflow.session import durable

#: Labelled rows a model is fitted on at most, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
BUCKETS = 1 << 18
#: Pseudo-tokens of the Dirichlet prior per bucket, split between the classes by their sizes.
PRIOR = 5.0
#: Taken off each token's log-odds, so that segments end where the evidence does.
DRIFT = 1.5
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Model:
    """`scores` by token bucket; `rate` and `scale` of the extreme-value law of clean segments; calibration weights."""

    scores: np.ndarray
    rate: float
    scale: float
    weights: tuple[float, float, float]


def _shared(rows: DataFrame, model: Model) -> Broadcast:
    """The model's numbers for all tasks. Plain values: executors need not know this package to unpack them."""
    return rows.sparkSession.sparkContext.broadcast((model.scores, model.rate, model.scale, model.weights))


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, lower-cased and without punctuation around it, and the texts' starts."""
    codes, starts, words = word_codes(texts, lower=True)
    return (crcs(pc.utf8_trim(words, PUNCTUATION)) % BUCKETS).astype(np.int64)[codes], starts


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a row of token scores, in linear time.

    Ruzzo and Tompa: each positive token opens a segment that swallows those
    before it as long as that makes it score more than they do.
    """
    total = np.cumsum(scores, dtype=np.float64)
    places = np.flatnonzero(scores > 0)
    left, right = (total[places] - scores[places]).tolist(), total[places].tolist()
    stack: list[tuple[int, float, float, int]] = []  # start, sum before, sum after, stack place of the last with a smaller sum before
    ends: list[int] = []
    for place, low, high in zip(places.tolist(), left, right):
        start = place
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][1] >= low:
                at = stack[at][3]
            if at < 0 or stack[at][2] >= high:
                stack.append((start, low, high, at))
                ends.append(place + 1)
                break
            start, low = stack[at][0], stack[at][1]
            del stack[at:], ends[at:]
    return [(s, e, r - l) for (s, l, r, _), e in zip(stack, ends)]


def _features(model: Model, scores: np.ndarray) -> tuple[float, float]:
    """Of the normalised scores of a document's segments: the best, and the sum of all that beat chance."""
    if not (scores > 0).any():
        return 0.0, 0.0
    best = np.array([s for *_, s in segments(scores)]) * model.rate - np.log(model.scale * max(len(scores), 1))
    return float(max(best.max(), 0.0)), float(np.maximum(best, 0.0).sum())


def _score(model: Model, features: np.ndarray) -> np.ndarray:
    a, b, c = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * features[:, 0] + c * features[:, 1], -30, 30)))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Clean and toxic rows that each token bucket is in: a word that one text repeats says little about the others.

    What reaches the driver is bounded by `BUCKETS`.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, toxic = strings(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            for at, stop in by_bytes(texts):
                buckets, starts = token_buckets(texts.slice(at, stop - at))
                own = np.unique(np.repeat(np.arange(stop - at), np.diff(starts)) * BUCKETS + buckets)
                label, buckets = toxic[at:stop][own // BUCKETS], own % BUCKETS
                for k in (0, 1):
                    found[k] += np.bincount(buckets[label == k], minlength=BUCKETS)
        used = np.flatnonzero(found.any(axis=0))
        yield pa.record_batch([pa.array(used), pa.array(found[0][used]), pa.array(found[1][used])], names=["b", "c0", "c1"])

    total = rows.select("text", "toxic").mapInArrow(thrifty(count), "b long, c0 long, c1 long").groupBy("b").agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[:, total["b"].to_numpy(np.int64)] = total[["c0", "c1"]].to_numpy(np.float64).T
    return out[0], out[1]


def _segments_of(rows: DataFrame, model: Model, summary) -> list:
    """summary(scores, label) of each labelled row, on the driver: `FIT_ROWS` rows at most."""
    shared = _shared(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            texts, toxic = strings(batch.column(0)), np.asarray(batch.column(1))
            for at, stop in by_bytes(texts):
                buckets, starts = token_buckets(texts.slice(at, stop - at))
                scores = m.scores[buckets]
                found = [summary(m, scores[starts[i]:starts[i + 1]]) for i in range(stop - at)]
                yield pa.record_batch([pa.array(toxic[at:stop].astype(np.int64)), pa.array([float(a) for a, _ in found]),
                                       pa.array([float(b) for _, b in found])], names=["toxic", "a", "b"])

    return rows.select("text", "toxic").mapInArrow(thrifty(run), "toxic long, a double, b double").toPandas().to_numpy(np.float64)


def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the clean tokens, by halving."""
    share = counts / counts.sum()
    low, high = 0.0, 1.0
    while (share * np.exp(np.minimum(high * scores, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * scores, 500))).sum() < 1 else (low, middle)
    return high


def _best_and_length(model: Model, scores: np.ndarray) -> tuple[float, float]:
    return max((s for *_, s in segments(scores)), default=0.0), len(scores)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weights of a logistic regression with an intercept, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic); the caller leaves held-out labels away.

    At most `fit_rows` labelled rows are used, so they can be sent to the
    documents; an id with several labels is toxic if any says so. The token
    log-odds get a Dirichlet prior in proportion to the class sizes. `rate`
    and `scale` say how often a clean text of n tokens has a segment of score
    s or more: scale * n * exp(-rate * s) times. Without labels of both kinds
    every text scores 0.
    """
    known = (labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = durable(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"))
    clean, toxic = _counts(rows)
    n0, n1 = clean.sum(), toxic.sum()
    if not n0 or not n1:
        return Model(np.zeros(BUCKETS, np.float32), 1.0, 1.0, (-30.0, 0.0, 0.0))
    share = n1 / (n0 + n1)
    odds = np.log((toxic + PRIOR * share) / n1) - np.log((clean + PRIOR * (1 - share)) / n0)
    scores = (odds - DRIFT).astype(np.float32)
    model = Model(scores, _rate(scores.astype(np.float64), clean), 1.0, (0.0, 0.0, 0.0))
    found = _segments_of(rows, model, _best_and_length)
    best, length = found[found[:, 0] == 0][:, 1], found[found[:, 0] == 0][:, 2]
    # The expected number of clean segments above the median best score gives the scale.
    middle = np.quantile(best, 0.5)
    model.scale = max(float(np.log(2) * np.exp(min(model.rate * middle, 50)) / max(length.mean(), 1)), 1e-6)
    found = _segments_of(rows, model, _features)
    model.weights = _fit_logistic(found[:, 1:], found[:, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `score` from 0 to 1, and `passages`: [start, stop) in words and score of each that beats chance.

    Null and empty texts score as one without any toxic token. Ids may be null
    or repeat; each row gets its own score.
    """
    shared = _shared(docs, model)
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts):
                buckets, starts = token_buckets(texts.slice(at, stop - at))
                scores, features, passages = m.scores[buckets], np.zeros((stop - at, 2)), []
                for i in range(stop - at):
                    own = scores[starts[i]:starts[i + 1]]
                    found = segments(own) if len(own) and own.max() > 0 else []
                    chance = np.log(m.scale * max(len(own), 1))
                    beats = [(s, e, x) for s, e, v in found if (x := v * m.rate - chance) > 0]
                    features[i] = (max((x for *_, x in beats), default=0.0), sum(x for *_, x in beats))
                    passages.append([{"start": s, "stop": e, "score": x} for s, e, x in beats])
                yield pa.record_batch([batch.column(0).slice(at, stop - at), pa.array(_score(m, features)),
                                       pa.array(passages, passage)], names=[id_col, "score", "passages"])

    return docs.select(id_col, text_col).mapInArrow(
        thrifty(run), f"`{id_col}` {kind}, score double, passages array<struct<start:bigint,stop:bigint,score:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below one half."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index(text_col)))
            for at, stop in by_bytes(texts):
                buckets, starts = token_buckets(texts.slice(at, stop - at))
                scores = m.scores[buckets]
                features = np.array([_features(m, scores[a:b]) for a, b in zip(starts[:-1], starts[1:])]).reshape(-1, 2)
                yield batch.slice(at, stop - at).filter(pa.array(_score(m, features) < 0.5))

    return docs.mapInArrow(thrifty(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))


@query("op6_toxic_segments")
def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_labels(spark, docs, sf_dir)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
