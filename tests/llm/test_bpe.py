import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from brute import edge_rows, words

from docflow.llm.bpe import LONG_PIECE, decode, encode, encode_batch, load, merge_long

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library():
    source, encoding = random.Random(1), reference()
    texts = ["", " ", "  ", "   ", "a   b", "a\n  b", "a \n b", "x\n ", "x ", " x", "  x", "\n\n  \n", "a" * 500, "ab" * 3000,
             "it's  'll", "日本語" * 100, "　 x 　 ", "é   b", "\x00\x01 \x1c \x1d  z", "<|endoftext|> a"]
    texts += ["".join(source.choice(" \n\ta.b1é  日\x1c'sю") for _ in range(source.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(source.choice("aeioubcdé日") for _ in range(n)) for n in range(LONG_PIECE - 5, LONG_PIECE + 200)]
    ids, starts = encode_batch(PATH, public_tokenizers.PATTERN, pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [encoding.encode_ordinary(t) for t in texts]


def test_long_pieces_like_the_library():
    source, encoding, ranks = random.Random(4), reference(), load(PATH)
    for letters in ("ab", "the", "aeioun", "日本語é"):
        text = "".join(source.choice(letters) for _ in range(3000))
        assert merge_long(ranks, ranks.of_byte[list(text.encode())].tolist()) == encoding.encode_ordinary(text)


def test_columns(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, " ".join(words(1, 30_000))), (3, "same"), (3, "same")]
    tokens = decode(encode(edge_rows(spark, rows), PATH, public_tokenizers.PATTERN), PATH)
    got = sorted(((r.doc_id or -1, bytes(r.content)) for r in tokens.collect()))
    assert got == sorted((i or -1, (t or "").encode()) for i, t in rows)
    assert encode(edge_rows(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    from docflow.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encoding = reference()
    for row in QUERIES["op7_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
