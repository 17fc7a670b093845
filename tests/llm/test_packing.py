import itertools
import zlib

import numpy as np
import pytest
from brute import edge_rows, words
from tokenizers import Tokenizer

from docflow.llm.packing import SEQUENCE_TOKENS, hilbert_key, pack, pack_stream, word_bpe_path


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    key = hilbert_key(points, bits)
    assert sorted(key.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check(rows, pieces, size):
    """Every id in one piece, sequences gapless, full or as long as a power of two."""
    tokenizer = Tokenizer.from_file(word_bpe_path())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, found in by_doc.items():
        times = sum(1 for j, _ in rows if j == i)
        assert sorted(x for s, n in found for x in range(s, s + n)) == sorted(list(range(len(ids[i]))) * times)
    assert set(by_doc) == {i for i, _ in rows}
    for found in by_sequence.values():
        found.sort()
        assert [o for o, _ in found] == [0, *itertools.accumulate(n for _, n in found)][:-1]
        total = sum(n for _, n in found)
        assert total <= size and total & (total - 1) == 0


def test_pieces(spark):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "<|endoftext|> İstanbul naïve café 日本"), (4, " ".join(words(2, 20_000))),
            (5, "same words"), (5, "same words")] + [(10 + i, " ".join(words(i, 40 + i))) for i in range(80)]
    check(rows, pack(edge_rows(spark, rows).repartition(4), word_bpe_path()).collect(), SEQUENCE_TOKENS)
    check(rows, pack(edge_rows(spark, rows), word_bpe_path(), size=64).collect(), 64)
    assert pack(edge_rows(spark, []), word_bpe_path()).count() == 0


def test_stream_ends_at_powers_of_two():
    found = list(pack_stream(iter([(1, np.arange(300, dtype="<u4")), (2, np.arange(41, dtype="<u4"))]), 128, 7))
    lengths = {}
    for *_, length, _, _, sequence, _ in found:
        lengths[sequence] = lengths.get(sequence, 0) + length
    assert list(lengths.values()) == [128, 128, 64, 16, 4, 1]


def test_query(spark):
    from docflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op9_pack_along_curve"](spark, "/root/testdata/sf0.001").collect(), SEQUENCE_TOKENS)
