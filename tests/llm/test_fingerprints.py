import hashlib
import random
from collections import Counter

from brute import edge_rows, words
from pyspark.sql import functions as F

from docflow.llm.fingerprints import SAMPLES, chain, in_stretches, likeness, near_edits, signatures, weighted_terms, with_next


def edits(rows):
    """By row in order: id, length and the edited text; rows of one id have one text here."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), text[:len(text) - half] + after[:half]))
    return out


def check(spark, rows):
    got = near_edits(edge_rows(spark, rows)).collect()
    want = Counter((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in edits(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    return got


def test_edited_texts(spark):
    source = random.Random(1)
    rows = [(i * source.choice([1, 7, 900]) + 3 * i, " ".join(words(i, source.randint(0, 60)))) for i in range(400)]
    rows = list(dict(rows).items()) + [(10**12, "é日 far away"), (-5, None), (-6, ""), (None, "no id at all"), (10**12 + 1, " \n ")]
    got = check(spark, rows)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) in (0, 8 * SAMPLES)
        prints.setdefault(r.fingerprint, []).append(r.doc_id)
    assert set(prints[""]) >= {-5, -6, 10**12 + 1}
    check(spark, [(1, "only one text")])
    check(spark, [(1, "same"), (1, "same"), (2, "same"), (3, "x " * 60_000)])
    assert near_edits(edge_rows(spark, [])).count() == 0


def test_ids_of_any_spread(spark):
    """Ids over the whole range of a long, a far one, one that many rows share, and nulls."""
    source = random.Random(4)
    spread = list({source.randrange(-2**63, 2**63): " ".join(words(i, source.randint(1, 5))) for i in range(700)}.items())
    check(spark, [*spread, (-5, "a b"), (2**63 - 1, "last"), (-2**63, "first"), (2**63 - 1, "last")])
    check(spark, [(-5, "a"), (0, "b"), (2**63 - 1, "c")])
    many = [(i, f"w{i % 50} x") for i in range(900)] + [(10**15, "far")] + [(400, "w0 x")] * 500 + [(None, "none")] * 300
    check(spark, many)
    sizes = in_stretches(edge_rows(spark, many), "doc_id", "text", 20).groupBy("_s1", "_s2").agg(
        F.count("*").alias("n"), F.countDistinct("_id", "_text").alias("different")).filter("different > 1").agg(F.max("n")).first()[0]
    assert sizes < 100


def test_plan_does_not_grow_with_stretches(spark):
    """The search for a row's stretch is written out once, not once more per step and join."""
    docs = edge_rows(spark, [(i, f"w{i} x") for i in range(640)])

    def length(stretch_rows):
        rows = in_stretches(docs, "doc_id", "text", stretch_rows).withColumn("_last", F.col("_next").isNull())
        told = with_next(rows, chain(rows), "_text", "_next", "_after")
        return len(told._jdf.queryExecution().optimizedPlan().toString())

    assert length(20) < 2 * length(320)


def test_equal_and_next(spark):
    text = " ".join(words(3, 200))
    got = {r.doc_id: r for r in near_edits(edge_rows(spark, [(3, text), (2, text), (1, "quite another thing")])).collect()}
    assert got[3].fingerprint == got[2].fingerprint and got[3].near_next == 1 and got[2].near_next == 0


def test_terms_and_collisions(spark):
    """Samples collide as often as the generalised Jaccard similarity says, weights included."""
    source = random.Random(2)
    rows, truth = [], []
    for i in range(600):
        pool = ["w%d_%d" % (i, j) for j in range(30)]
        a, b = Counter(source.choices(pool, k=80)), Counter(source.choices(pool[:20] + ["v%d" % j for j in range(10)], k=60))
        rows.append((i, " ".join(a.elements()), " ".join(b.elements())))
        truth.append(sum((a & b).values()) / sum((a | b).values()))
    table = spark.createDataFrame(rows, "i long, a string, b string")
    terms = table.select(F.inline(weighted_terms(F.col("a")))).agg(F.sum("n")).first()[0]
    assert terms == 600 * 80
    a, b = (signatures(table, ["i"], c).withColumnRenamed("signature", c) for c in "ab")
    found = a.join(b, "i").select(F.avg(likeness(F.col("a"), F.col("b")))).first()[0]
    assert abs(found - sum(truth) / len(truth)) < 0.02
