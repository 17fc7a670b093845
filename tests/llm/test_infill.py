import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from brute import edge_rows
from pyspark.sql import functions as F

from docflow.llm.infill import RankIndex, boundaries, fill_in_middle, restored


def expected(doc_id, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, len(units))))
    if not text or re.search("<[PSM]>", text) or three % 100 >= 90:
        return len(units), "plain", None, None, text
    if four % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def hard_texts():
    source = random.Random(5)
    texts = [None, "", " ", "a", "é", "日本語", "<P", "<P>", "x<S>y", "<", "<<<", "S>M>P>", "ab\x00cd\n\r\n", "A" * 30_000, "-" * 30_000,
             "a" * 20_000 + ". " * 9_000 + "日é" * 5_000 + "bc d", "a-" * 40_000]
    return texts + ["".join(source.choice(["<", "P", "S>", "ab", " ", "é", "🙂", ".", "\n", "Zz"]) for _ in range(source.randint(1, 60)))
                    for _ in range(300)]


def test_forms_and_way_back(spark):
    rows = list(enumerate(hard_texts())) + [(None, "no id at all"), (7, "same id"), (7, "same id"), (-5, "minus")]
    made = fill_in_middle(edge_rows(spark, rows).withColumns({"form": F.lit(1), "a b": F.lit("kept")}).repartition(3))
    assert made.columns == ["doc_id", "_r1", "_line", "ids", "score", "a b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *expected(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"} and all(r["a b"] == "kept" and r._r1 == "x" for r in got)


def test_empty_table(spark):
    assert fill_in_middle(edge_rows(spark, [])).count() == 0


def test_every_boundary_is_found_from_few_lines():
    texts = pa.array([t or "" for t in hard_texts()], pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)
    offsets, first = boundaries(np.frombuffer(texts.buffers()[2], np.uint8), starts)
    for text, a, b in zip(texts.to_pylist(), first, first[1:]):
        units = [len(u.encode()) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert offsets[a:b].tolist() == [0, *np.cumsum(units).tolist()] if units else offsets[a:b].tolist() == [0]
    for error in (0, 3, 100):
        index = RankIndex(offsets, first, error)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all() and np.abs(index.residual).max() <= error
    assert len(index.first) < len(offsets) / 100


def test_query_plan_has_no_shuffle(spark):
    from docflow.llm.queries import QUERIES

    plan = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan
