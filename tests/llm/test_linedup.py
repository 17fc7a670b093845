import hashlib
import random

from brute import edge_rows, near
from pyspark.sql import functions as F

from docflow.llm.linedup import NEAR_CHARS, dedup_lines


def expected(rows):
    """By (doc_id, text): the kept text, lines and removed lines; for tables without two texts under one id."""
    order = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for doc_id, text in order:
        if text is None:
            out[(doc_id, text)] = (None, 0, 0)
            continue
        kept, n, removed = [], 0, 0
        for line in text.split("\n"):
            if not line.strip(" "):
                kept.append(line)
                n += 1
                continue
            n += 1
            again = any(s == line or (len(line) >= NEAR_CHARS and len(s) >= NEAR_CHARS and near(s, line)) for s in seen)
            seen.append(line)
            removed += again
            if not again:
                kept.append(line)
        out[(doc_id, text)] = ("\n".join(kept), n, removed)
    return out


def check(spark, rows):
    own = {c: F.lit(f"own {c}") for c in ("_cut", "_kept", "_text", "_found", "n_lines")}
    out = dedup_lines(edge_rows(spark, rows).withColumns(own))
    assert out.columns == ["doc_id", "text", "_r1", "_line", "ids", "score", "_cut", "_kept", "_text", "_found", "n_lines", "n_removed"]
    got = out.collect()
    assert all((r._r1, r._line, r._cut, r._kept, r._text) == ("x", 1, "own _cut", "own _kept", "own _text") for r in got)
    want = expected(rows)
    by_id = {k[0]: v for k, v in want.items()}
    assert len(got) == len(rows)
    for row in got:
        assert (row.text, row.n_lines, row.n_removed) == by_id[row.doc_id], row.doc_id


def edited(source, line):
    at = source.randrange(len(line) + 1)
    kind = source.randrange(3)
    letter = source.choice("abé日")
    return line[:at] + ("" if kind == 0 else letter) + line[at + (kind != 1):]


def test_against_brute_force(spark):
    source = random.Random(3)
    lines = ["".join(source.choice("ab cdé") for _ in range(source.choice([1, 5, 19, 20, 21, 30, 64, 200]))) for _ in range(60)]
    lines += [edited(source, source.choice(lines)) for _ in range(120)] + ["a" * n for n in range(15, 45)] + ["", " "]
    rows = [(i, "\n".join(source.choice(lines) for _ in range(source.randint(0, 8)))) for i in range(120)]
    check(spark, rows)


def test_edges(spark):
    long = "x" * 70_000
    check(spark, [(None, "only here, in a null id"), (1, None), (2, ""), (3, "\n\n"), (4, long), (5, long[:-1] + "y"),
                  (6, "only here, in a null id"), (7, "a\nb\na"), (7, "a\nb\na"), (8, "only there, in a null id")])
    assert dedup_lines(edge_rows(spark, [])).count() == 0


def test_query_counts(spark):
    from docflow.llm.queries import QUERIES

    got = QUERIES["op10_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {k[0]: v for k, v in expected(rows).items()}
    assert len(got) == len(rows)
    for row in got:
        text, n, removed = want[row.doc_id]
        assert (row.n_lines, row.n_removed, row.kept_sha256) == (n, removed, hashlib.sha256((text or "").encode()).hexdigest())
