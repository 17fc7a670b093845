import random
import re
from functools import cache

import numpy as np
import pytest
from brute import edge_rows, words
from pyspark.sql import functions as F

from docflow.llm.superkmers import drop_repeats, super_kmers


def expected(rows, window):
    """Per different row: words, removed words and what is kept, by looking up every window."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(found), bool)
        for i in range(len(found) - window + 1):
            key = tuple(found[i:i + window])
            gone[i:i + window] |= key in seen
            seen.add(key)
        out[doc_id, text] = (len(found), int(gone.sum()), " ".join(w for w, g in zip(found, gone) if not g))
    return sorted(((i, *out[i, t]) for i, t in rows), key=repr)


@cache
def shared_rows(window):
    source, rows = random.Random(window), []
    passage = words(900, 3 * window)
    pool = [words(100 + i, 2 * window, 40) for i in range(5)] + [["x"] * 3 * window, ["é", "日本"] * window]
    for i in range(150):
        parts = words(i, source.randint(0, window))
        for _ in range(source.randint(0, 3)):
            piece = source.choice(pool)
            cut = source.randint(0, window // 2)
            parts += piece[cut:len(piece) - source.randint(0, window // 2)] + words(1000 + i, source.randint(0, 3))
        rows.append((i, source.choice([" ", "\t\n", "  \x0b"]).join(parts)))
    # One passage in very many surroundings, and copies of one text.
    rows += [(200 + i, " ".join([*words(i, 3), *passage[:window + i % 5], *words(50 + i, 3)])) for i in range(60)]
    return rows + [(400 + i, " ".join(passage)) for i in range(60)]


@pytest.mark.parametrize("window, size, together, hot", [(20, 5, 20_000, 5_000), (20, 5, 3, 5_000), (20, 5, 20_000, 20), (4, 9, 2, 30), (1, 1, 5, 40)])
def test_against_every_window(spark, window, size, together, hot):
    rows = shared_rows(window) + [(None, "null id " * window), (1000, None), (1001, ""), (1002, " \n"), (1003, "too short"),
                                  (1004, "null id " * 9 * window), (1005, "same row " * window), (1005, "same row " * window),
                                  (-7, " ".join(words(1, 50))), (1006, "a b\x1cc " * 3 * window)]
    docs = edge_rows(spark, rows).withColumns({"key": F.lit("mine"), "kept": F.lit(0)}).repartition(3)
    out = drop_repeats(docs, window=window, size=size, together=together, hot_rows=hot)
    assert out.columns == ["doc_id", "_r1", "_line", "ids", "score", "key", "n_words", "n_removed", "kept"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == expected(rows, window)
    assert all(r.key == "mine" and r._r1 == "x" for r in got)


def test_same_id_twice(spark):
    """Rows of one id with different texts: one of them is the earlier one, for all of its words."""
    shared = " ".join(words(5, 30))
    got = {r.kept for r in drop_repeats(edge_rows(spark, [(1, f"a {shared}"), (1, f"b {shared}")])).collect()}
    assert got in ({f"a {shared}", "b"}, {"a", f"b {shared}"})


def test_empty_table(spark):
    assert drop_repeats(edge_rows(spark, [])).count() == 0


def test_every_window_is_in_one_super_kmer():
    hashes = np.random.default_rng(2).integers(0, 5, 3000).astype(np.uint64)
    starts = np.array([0, 900, 900, 905, 3000])
    found, keys = super_kmers(hashes, starts, 12, 3)
    places = [p for a, n in found for p in range(a, a + n)]
    assert places == [p for s, e in zip(starts[:-1], starts[1:]) for p in range(s, e - 12 + 1)]
    assert found[:, 1].max() <= 10
    by_window = {}
    for (a, n), key in zip(found, keys):
        for p in range(a, a + n):
            assert by_window.setdefault(tuple(hashes[p:p + 12]), key) == key
