import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from docflow.functions.units import pattern_unit, tokenizer_unit, units_in
from docflow.operators import chunk


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 1), (512, 1), (513, 2), (1004, 2), (1005, 3)])
def test_chunk_counts(spark, n, expected):
    assert chunk.chunk_words(texts(spark, [" ".join(["w"] * n)])).count() == expected


def test_golden_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    row = chunk.chunk_words(docs).selectExpr("count(*) n", "sum(n_words) w").first()
    assert (row.n, row.w) == (1355, 397271)


@pytest.mark.parametrize("size, overlap", [(5, 2), (3, 0), (7, 6), (1, 0)])
def test_chunks_are_substrings_that_cover_every_word(spark, size, overlap):
    values = ["  a b\n\nc  d e f g h i j k \t l m\n", "one", "", " \n ", "x y z é ç 😊 w v u t s r q p o"]
    rows = chunk.chunk_words(texts(spark, values), size, overlap).collect()
    for i, value in enumerate(values):
        chunks = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in chunks] == list(range(len(chunks)))
        rebuilt = []
        for r in chunks:
            own = r.text.split()
            assert len(own) == r.n_words <= size
            units = value.encode("utf-32-le").decode("utf-32-le")
            assert units[r.start_char:r.end_char] == r.text
            rebuilt = rebuilt + own if not rebuilt else rebuilt[:len(rebuilt) - overlap] + own
        assert rebuilt == value.split()


def test_sizes_are_checked(spark):
    for size, overlap in [(5, 5), (5, -1)]:
        with pytest.raises(ValueError):
            chunk.chunk_words(texts(spark, ["a"]), size, overlap)


def test_node_ids_depend_on_document_and_place_only(spark):
    df = chunk.with_lineage(chunk.chunk_words(texts(spark, ["a b c d", "a b c d"]), 2, 0))
    ids = [r.node_id for r in df.collect()]
    assert len(set(ids)) == 4
    assert sorted(ids) == sorted(r.node_id for r in df.collect())


def test_vault_paragraphs(spark):
    rows = chunk.chunk_paragraphs(texts(spark, ["a\n\nb\n---\nc [[link]] d"])).collect()
    assert [r.text.strip() for r in sorted(rows, key=lambda r: r.para_no)] == ["a", "b", "c", "d"]


def test_markdown_headings_and_fences(spark):
    text = "intro\n# A\nx\n```\n# not\n```\n## B\ny\n# C\n### D\n#no heading\n"
    rows = sorted(chunk.split_markdown(texts(spark, [text, "", "```\n# open fence"])).collect(),
                  key=lambda r: (r.doc_id, r.section_no))
    assert [(r.level, r.heading, r.header_path, r.text) for r in rows] == [
        (0, "", "", "intro"), (1, "A", "", "# A\nx\n```\n# not\n```"), (2, "B", "A", "## B\ny"),
        (1, "C", "", "# C"), (3, "D", "C", "### D\n#no heading"), (0, "", "", "```\n# open fence")]


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed greedily into at most `size` words, the last ones repeated up to `overlap` words."""
    sentences = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        tokens = sentence.split()
        sentences.extend(tokens[i:i + size] for i in range(0, len(tokens), size))
    packed, current, fresh = [], [], False
    for sentence in sentences:
        if fresh and sum(map(len, current)) + len(sentence) > size:
            packed.append(current)
            tail, room = [], min(overlap, size - len(sentence))
            for earlier in reversed(current):
                if len(earlier) > room:
                    break
                tail.insert(0, earlier)
                room -= len(earlier)
            current = tail
        current = current + [sentence]
        fresh = True
    if current:
        packed.append(current)
    return [" ".join(token for sentence in chunk for token in sentence) for chunk in packed]


@given(st.lists(st.text(alphabet="ab.!? \n", max_size=60), max_size=4), st.integers(2, 9), st.integers(0, 1))
@settings(max_examples=200, deadline=None)
def test_packed_sentences(parts, size, overlap):
    text = " ".join(parts)
    chunks = pack_sentences(text, size, overlap)
    assert all(1 <= len(c.split()) <= size for c in chunks)
    if overlap == 0:
        assert [w for c in chunks for w in c.split()] == text.split()
    else:
        assert set(text.split()) == {w for c in chunks for w in c.split()}


def test_packing_keeps_sentences_whole_and_repeats_the_last(spark):
    rows = chunk.chunk_sentences(texts(spark, ["A b. C d. E f. G h i j k l m."]), 4, 2).orderBy("chunk_no").collect()
    assert [r.text for r in rows] == ["A b. C d.", "C d. E f.", "G h i j", "k l m."]


def test_packed_chunks_of_the_documents_cover_all_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    packed = chunk.chunk_sentences(docs, 64, 0)
    words = {}
    for r in packed.orderBy("doc_id", "chunk_no").collect():
        words.setdefault(r.doc_id, []).extend(r.text.split())
    for r in docs.collect():
        assert words.get(r.doc_id, []) == re.findall(r"\S+", r.text)


def test_sentence_chunks_are_those_of_the_plain_packer_and_in_place(spark):
    source = random.Random(6)
    given = [None, "", " ", "x", "\n a.  b!\n\nc"] + [
        "".join(source.choice(["a", "bb", "c.", "d!", "e?", ".", " ", "  ", "\n", " ", " "]) for _ in range(source.randint(0, 80))) for _ in range(150)]
    for size, overlap in [(4, 2), (3, 0), (9, 5), (1, 0)]:
        rows = chunk.chunk_sentences(texts(spark, given), size, overlap).collect()
        for i, text in enumerate(given):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_no)
            assert [" ".join(r.text.split()) for r in own] == pack_sentences(text or "", size, overlap), text
            assert all(text[r.start_char:r.end_char] == r.text and r.n_words == len(r.text.split()) for r in own)


def test_markdown_tilde_fences_and_control_characters(spark):
    text = "~~~\n# not\n~~~\n# A\none \x01 two\n~~~\n## not\n~~~\n```\n# no\n```\n## B\nend"
    rows = sorted(chunk.split_markdown(texts(spark, [text])).collect(), key=lambda r: r.section_no)
    assert [(r.level, r.heading, r.header_path) for r in rows] == [(0, "", ""), (1, "A", ""), (2, "B", "A")]
    assert rows[1].text == "# A\none \x01 two\n~~~\n## not\n~~~\n```\n# no\n```"


def pack(pieces, size, overlap):
    """Greedy packing of (text, words) pieces, the last ones of a chunk repeated up to `overlap` words; first and last piece of each chunk."""
    packed, first, words = [], 0, 0
    for i, (_, n) in enumerate(pieces):
        if i > first and words + n > size:
            packed.append((first, i - 1))
            room, start, words = min(overlap, size - n), i, 0
            while start > first and words + pieces[start - 1][1] <= room:
                start -= 1
                words += pieces[start][1]
            first = start
        words += n
    return packed + ([(first, len(pieces) - 1)] if pieces else [])


def test_paragraph_runs_are_those_of_the_plain_packer_and_in_place(spark):
    source = random.Random(9)
    parts = ["a b", "c", "d e f g h i j", " ", "", "[[link]]", "\n\n", "\n---\n", "\n-----\n", "x [[y]] z", "\t", "é 日"]
    given = [None, "", " \n\n ", "[[only]]", "\n\nlead", "a\n\nb\n---\nc [[link]] d"] + [
        "".join(source.choice(parts) for _ in range(source.randint(0, 25))) for _ in range(200)]
    for size, overlap in [(4, 2), (3, 0), (9, 5), (1, 0)]:
        rows = chunk.chunk_paragraph_runs(texts(spark, given), size=size, overlap=overlap).collect()
        for i, text in enumerate(given):
            pieces = []
            for paragraph in re.split(r"\n\n|\n-{3,}\n|\[\[.*?\]\]", text or ""):
                own = paragraph.split()
                pieces += [(own[j:j + size], len(own[j:j + size])) for j in range(0, len(own), size)]
            chunks = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_no)
            want = pack(pieces, size, overlap)
            assert [r.n_words for r in chunks] == [sum(n for _, n in pieces[a:b + 1]) for a, b in want], text
            for r, (a, b) in zip(chunks, want):
                assert text[r.start_char:r.end_char] == r.text == r.text.strip()
                assert r.text.startswith(" ".join(pieces[a][0][:1])) and r.text.endswith(pieces[b][0][-1])
                bare = re.sub(r"\[\[.*?\]\]|\n-{3,}\n", " ", r.text).split()
                assert bare == [w for own, _ in pieces[a:b + 1] for w in own]


def test_packing_takes_time_in_proportion_to_the_text(spark):
    def seconds(n):
        text = " ".join(f"w{i}." if i % 11 == 0 else f"w{i}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").cache()
        docs.count()
        start = time.time()
        found = chunk.chunk_sentences(docs).agg({"n_words": "sum"}).first()[0]
        assert found >= n
        return time.time() - start

    seconds(1000)
    short, long = min(seconds(60_000) for _ in range(2)), seconds(480_000)
    assert long < 24 * max(short, 0.1)  # eight times the words; a quadratic plan takes 64 times as long


def test_units_other_than_words(spark):
    """Tokens by a pattern and by a tokenizer: pieces join to the text, chunks are substrings of so many tokens."""
    def load():
        def starts(batch):  # two tokens for the first character of each word, as a byte-level tokenizer may give
            return [[p for m in re.finditer(r"\s*\S+", t) for p in (m.start(), m.start())] for t in batch]
        return starts

    given = [None, "", "  ", " ab cdefg, é!", "日本語 text\n", "a" * 30]
    docs = texts(spark, given)
    for unit in (pattern_unit("[A-Za-z0-9]{1,4}"), tokenizer_unit(load)):
        found = {r.doc_id: r for r in docs.select("doc_id", "text", unit(docs.text).alias("u"), units_in(unit, docs.text).alias("n")).collect()}
        assert all("".join(r.u or []) == (r.text or "").lstrip() and r.n == len(r.u or []) for r in found.values())
        rows = chunk.chunk_words(docs, 3, 1, unit=unit).collect()
        assert all(r.text == given[r.doc_id][r.start_char:r.end_char] and 1 <= r.n_words <= 3 for r in rows)
    assert found[3].n == 6 and found[4].n == 4
    assert [r.u for r in docs.filter("doc_id = 3").select(pattern_unit("[A-Za-z0-9]{1,4}")(docs.text).alias("u")).collect()] == [["ab ", "cdef", "g", ", ", "é", "!"]]
