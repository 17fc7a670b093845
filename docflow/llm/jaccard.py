"""Documents whose word shingles overlap by a threshold: banded MinHash, Bayesian pruning, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm.registry import query, table
from docflow.llm.rows import components, held, with_row_key
from docflow.llm.words import by_bytes, give_back, mix, strings, thrifty, word_codes
from docflow.session import durable

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 32, three in a million.
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
#: Values compared before each look at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Different texts in a block; groups are compared block by block.
BLOCK = 256
FACTORS = mix(np.arange(HASHES, dtype=np.uint64), 5) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of each text's different shingles, and the texts' starts.

    Words are lower-cased (A to Z). A text of fewer words is one shingle; one without words has none.
    """
    codes, starts, found = word_codes(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.cast(pa.large_binary()).to_pylist()), np.uint64, len(found))
    own, counts = hashes[codes], np.diff(starts)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(own), np.uint64)
        for i in range(words):
            # Behind the end of a text of fewer words nothing is added.
            inside = np.arange(len(own)) + i < np.repeat(starts[1:], counts)
            shifted = np.concatenate([own[i:], np.zeros(min(i, len(own)), np.uint64)])
            rolled = rolled * base + np.where(inside, shifted, np.uint64(0))
    place = np.arange(len(own)) - np.repeat(starts[:-1], counts)
    keep = place <= np.maximum(np.repeat(counts, counts) - words, 0)
    rolled, doc = mix(rolled[keep], 1), np.repeat(np.arange(len(texts)), counts)[keep]
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    first = np.ones(len(rolled), bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])
    return rolled[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(texts)))])


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row per text, zeros where there is no shingle."""
    out = np.zeros((len(starts) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        with np.errstate(over="ignore"):
            for j in range(HASHES):
                out[full, j] = np.minimum.reduceat(sets * FACTORS[j], starts[full]) >> np.uint64(32)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared, the matches below which the posterior of reaching the threshold is too small.

    With an even prior the posterior of the similarity is a Beta, and its part
    above the threshold a sum of binomial terms.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        out[n] = m
    return out


def _nodes(docs: DataFrame) -> DataFrame:
    """Per row the hash of its shingle set (`node`, null without shingles) and its band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(3))
            for at, stop in by_bytes(texts):
                sets, starts = shingle_sets(texts.slice(at, stop - at))
                values = signatures(sets, starts).astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
                for i in range(BAND_ROWS):
                    keys = mix(keys ^ values[:, :, i], i)
                n = np.diff(starts)
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32),
                                                 np.ascontiguousarray(keys[n > 0]).view(np.int64).ravel())
                yield pa.record_batch([*(batch.column(i).slice(at, stop - at) for i in range(3)),
                                       pa.array(node_ids(sets, starts), mask=n == 0), bands],
                                      names=["_id", "_r1", "_r2", "node", "bands"])

    return docs.mapInArrow(thrifty(run), "_id long, _r1 long, _r2 long, node long, bands array<long>")


def node_ids(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(sets[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])], np.uint64).view(np.int64)


def _candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of each band key: each one with the smallest there."""
    keys = nodes.filter("node is not null").select("node", F.explode("bands").alias("key"))
    smallest = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("hi")).filter("b <> hi").select("key", "b")
    return keys.join(smallest, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _content(texts: DataFrame) -> DataFrame:
    """MinHash values and shingle sets of one text per candidate node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = strings(batch.column(2))
            for at, stop in by_bytes(found):
                sets, starts = shingle_sets(found.slice(at, stop - at))
                values = signatures(sets, starts)
                yield pa.record_batch([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at),
                                       pa.array([v.tobytes() for v in values], pa.binary()),
                                       pa.array([sets[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())],
                                      names=["node", "root", "hashes", "shingles"])

    return texts.mapInArrow(thrifty(run), "node long, root long, hashes binary, shingles binary")


def _in_blocks(content: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows dealt to units: small groups share a unit, large ones are cut into blocks and each pair of blocks is a unit."""
    sized = content.join(roots.groupBy("root").agg(F.count("*").alias("_m")), "root")
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    sized = sized.withColumns({"_blocks": blocks, "_own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    return sized.select("node", "root", "hashes", "shingles", "_own", F.explode(
        F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")).select(
            "node", "root", "hashes", "shingles", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def linked_pairs(hashes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                 threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (left[i], right[i]) that reach the threshold.

    MinHash values are compared step by step; after each, pairs that are too
    unlikely to reach the threshold go. The others are counted exactly.
    """
    sizes = np.array([len(s) for s in sets])
    low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    able = low >= threshold * high
    left, right = left[able], right[able]
    matches = np.zeros(len(left), np.int64)
    for n, least in least_matches(threshold).items():
        matches += (hashes[left, n - STEP:n] == hashes[right, n - STEP:n]).sum(axis=1)
        likely = matches >= least
        left, right, matches = left[likely], right[likely], matches[likely]
    both = _shared(sets, left, right)
    linked = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
    return left[linked], right[linked]


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of shingles in both texts of each pair."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(column.max()) + 1, 4096):
        inside = (column >= at) & (column < at + 4096)
        part = np.zeros((len(used), 4096), np.float32)
        part[row[inside], column[inside] - at] = 1
        total += part @ part.T
    return np.rint(total[place[left], place[right]]).astype(np.int64)


def _compare(unit: pd.DataFrame) -> pd.DataFrame:
    """Links of each node within a unit, and the smallest node it is connected with there."""
    out = []
    for _, group in unit.groupby("root", sort=False):
        group = group.drop_duplicates("node")
        if len(group) < 2:
            continue
        nodes, own = group["node"].to_numpy(), group["_own"].to_numpy()
        hashes = np.frombuffer(b"".join(group["hashes"]), np.uint32).reshape(len(nodes), HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        if group["_i"].iloc[0] == group["_j"].iloc[0]:
            left, right = np.triu_indices(len(nodes), 1)
        else:
            first = own == group["_i"].iloc[0]
            left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij"))
        left, right = linked_pairs(hashes, sets, left, right)
        if not len(left):
            continue
        order = np.argsort(np.argsort(nodes))
        label = order.copy()
        while True:
            low, before = np.minimum(label[left], label[right]), label.copy()
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            if (label == before).all():
                break
        links = np.bincount(left, minlength=len(nodes)) + np.bincount(right, minlength=len(nodes))
        hit = links > 0
        out.append(pd.DataFrame({"node": nodes[hit], "links": links[hit], "b": np.sort(nodes)[label[hit]]}))
    give_back()
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "b": []}).astype("int64")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row `_id`, `_r1`, `_r2`, `class_id`, `n_links`, and `first`, which is true on one row's key of each class.

    Two texts are linked if their sets of five-word shingles have a Jaccard
    similarity of `THRESHOLD` or more; texts with the same set are copies and
    one node. `n_links` counts the other nodes a row's text is linked with, so
    copies are not counted. A class is what links connect; its id is its
    smallest document id (null only if all its ids are null). Texts without
    words (null and empty ones too) are classes of their own and link nothing;
    texts of fewer than five words are one shingle. Ids may be null or repeat.

    Band keys only connect: every node with the smallest one that has the same
    key. Groups so connected are compared block by block, and no pair leaves a
    task: only counts and the smallest connected node do.
    """
    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    nodes = durable(_nodes(keyed.select("_id", "_r1", "_r2", "_text")))
    roots = held(components(_candidates(nodes)))
    holders = nodes.join(roots, "node").groupBy("node", "root").agg(F.min(F.struct("_r1", "_r2")).alias("_r")).select(
        "node", "root", "_r._r1", "_r._r2")
    texts = keyed.select("_r1", "_r2", "_text").join(holders, ["_r1", "_r2"]).select("node", "root", "_text")
    dealt = _in_blocks(_content(texts), roots)
    units = F.when(F.col("_j") > 0, F.xxhash64("root", "_i", "_j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(_units(roots))))
    links = held(dealt.withColumn("_unit", units).groupBy("_unit", "_i", "_j").applyInPandas(
        _compare, "node long, links long, b long"))
    classes = components(links.select(F.col("node").alias("a"), "b"))
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    rows = nodes.join(classes, "node", "left").join(counted, "node", "left").withColumn(
        "_class", F.coalesce("root", "node", F.xxhash64("_r1", "_r2", F.lit(3))))
    firsts = rows.groupBy("_class").agg(F.min("_id").alias("class_id"), F.min(F.struct(F.col("_id").isNull(), "_id", "_r1", "_r2")).alias("_f"))
    return rows.select("_id", "_r1", "_r2", "_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).join(
        firsts, "_class").select("_id", "_r1", "_r2", "class_id", "n_links",
                                 ((F.col("_r1") == F.col("_f._r1")) & (F.col("_r2") == F.col("_f._r2"))).alias("first"))


def _units(roots: DataFrame) -> int:
    """Units that small groups are dealt to, of some hundred nodes each."""
    return max(8, roots.count() // (2 * BLOCK))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand first in their class: smallest id, then row key. Of equal rows one stays."""
    kept = near_classes(docs, id_col, text_col).filter("first").select("_r1", "_r2").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = with_row_key(docs.select(row.alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")),
                         "_id", "_text").select("_row", "_r1", "_r2")
    return keyed.join(kept, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


@query("op5_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^ \t\n\v\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END),
                lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s FROM w),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS g FROM nodes),
links AS (SELECT a, b FROM (SELECT x.node AS a, y.node AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
                            FROM shingles x JOIN shingles y ON x.g = y.g AND x.node <> y.node GROUP BY ALL) WHERE common >= 0.8 * (na + nb - common) - 1e-9),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS node, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN classes USING (node) LEFT JOIN counts USING (node)""")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "class_id", "n_links")
