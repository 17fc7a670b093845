"""Splitting texts into chunks. All of it happens inside the row, so no chunker shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions.text import WORD_SPACE, has_text, words
from docflow.functions.vectors import let


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")


def chunk_array(text: Column, tokens: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_no, text, start_char, end_char, n_words) for one text and its words.

    Each chunk is an exact substring of the text; offsets count characters from 0.
    """
    step = size - overlap
    n = F.size(tokens)
    count = F.when(n > 0, F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1))).otherwise(0).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(WORD_SPACE)))
    # Where chunk i starts: the lengths of the i steps before it.
    offsets = F.aggregate(
        F.transform(numbers, lambda i: F.length(F.array_join(F.slice(tokens, i * step + 1, F.lit(step)), ""))),
        F.array(lead), lambda seen, length: F.concat(seen, F.array(F.element_at(seen, -1) + length)))

    def chunk(i, starts):
        part = F.slice(tokens, i * step + 1, F.lit(size))
        body = F.rtrim(F.array_join(part, ""), F.lit(WORD_SPACE))
        start = F.element_at(starts, i + 1)
        return F.struct(
            i.alias("chunk_no"), body.alias("text"), start.alias("start_char"),
            (start + F.length(body)).alias("end_char"), F.size(part).alias("n_words"))

    return let(offsets, lambda starts: F.transform(numbers, lambda i: chunk(i, starts)))


def chunk_words(df: DataFrame, size: int = 512, overlap: int = 20, text: str = "text", unit: Callable[[Column], Column] = words) -> DataFrame:
    """One row per window of `size` words, neighbours sharing `overlap` words.

    Blank texts give no rows. The other columns are carried along. `unit` gives
    what is counted instead of words, see `docflow.functions.units`; `n_words`
    counts it.
    """
    _check(size, overlap)
    carried = [c for c in df.columns if c != text]
    return (df.withColumn("_tokens", unit(F.col(text)))
            .select(*carried, F.inline(chunk_array(F.col(text), F.col("_tokens"), size, overlap))))


def with_lineage(chunks: DataFrame, doc_id: str = "doc_id", parts: tuple[str, ...] = ("chunk_no",)) -> DataFrame:
    """Node ids that depend only on the document and the chunk's place in it."""
    return chunks.withColumn("ref_doc_id", F.col(doc_id).cast("string")).withColumn(
        "node_id", F.sha2(F.concat_ws("#", "ref_doc_id", *parts), 256))


# Fixed value: what separates paragraphs of notes.
PARAGRAPH = r"\n\n|\n-{3,}\n|\[\[.*?\]\]"


def chunk_paragraphs(df: DataFrame, separator: str = PARAGRAPH, size: int = 512, overlap: int = 20, text: str = "text") -> DataFrame:
    """Split on the separator pattern, drop blank paragraphs, then chunk each paragraph.

    Chunks are numbered through the whole text and their offsets are those in
    it, so a chunk's number names it. `para_no` counts blank paragraphs too.
    """
    _check(size, overlap)
    carried = [c for c in df.columns if c != text]

    def located(pieces: Column, gaps: Column) -> Column:
        """Pieces with their number and where they start: behind all earlier pieces and separators."""
        lengths = F.transform(pieces, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0)))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)))
        return let(starts, lambda s: F.transform(pieces, lambda p, i: F.struct(i.alias("no"), p.alias("text"), F.get(s, i).alias("start"))))

    def chunks(paragraph: Column) -> Column:
        found = let(words(paragraph["text"]), lambda tokens: chunk_array(paragraph["text"], tokens, size, overlap))
        return F.transform(found, lambda c: F.struct(
            paragraph["no"].alias("para_no"), c["text"].alias("text"), (c["start_char"] + paragraph["start"]).alias("start_char"),
            (c["end_char"] + paragraph["start"]).alias("end_char"), c["n_words"].alias("n_words")))

    located_all = let(F.split(F.col(text), separator), lambda pieces: let(
        F.regexp_extract_all(F.col(text), F.lit(separator), F.lit(0)), lambda gaps: located(pieces, gaps)))
    full = F.filter(located_all, lambda p: has_text(p["text"]))
    return df.select(*carried, F.posexplode(F.flatten(F.transform(full, chunks))).alias("chunk_no", "_c")).select(*carried, "chunk_no", "_c.*")


NO_CHUNKS = "array<struct<chunk_no:int,text:string,start_char:int,end_char:int,n_words:int>>"


def packed_runs(pieces: Column, lead: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_no, text, start_char, end_char, n_words): runs of whole pieces of at most `size` words.

    A piece is (text, tail, n): its text, what lies between it and the next one,
    and its words, one at least and `size` at most. `lead` characters come
    before the first. The next run begins with the last pieces of at most
    `overlap` words that leave room for the first new one.

    One pass with running sums of words and characters; only where a run ends
    are pieces looked back at, and no more of them than `overlap`.
    """
    def packed(p: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            def place(piece: Column) -> Column:
                behind = state["at"] + F.length(piece["text"]) + F.length(piece["tail"])
                room = F.least(F.lit(overlap), F.lit(size) - piece["n"])
                look = F.sequence(F.lit(1), F.least(at - state["first"], F.lit(max(overlap, 1))))

                def take(seen: Column, back: Column) -> Column:
                    earlier = F.get(p, at - back)
                    fits = seen["open"] & (seen["words"] + earlier["n"] <= room)
                    return F.when(fits, F.struct(
                        (seen["pieces"] + 1).alias("pieces"), (seen["words"] + earlier["n"]).alias("words"),
                        (seen["chars"] + F.length(earlier["text"]) + F.length(earlier["tail"])).alias("chars"), F.lit(True).alias("open"),
                    )).otherwise(seen.withField("open", F.lit(False)))

                none = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("words"), F.lit(0).alias("chars"), F.lit(overlap > 0).alias("open"))
                again = F.aggregate(look, none, take)
                return F.when(state["words"] + piece["n"] <= size, F.struct(
                    state["first"].alias("first"), (state["words"] + piece["n"]).alias("words"), state["begin"].alias("begin"),
                    behind.alias("at"), state["done"].alias("done"))).otherwise(let(again, lambda kept: F.struct(
                        (at - kept["pieces"]).alias("first"), (kept["words"] + piece["n"]).alias("words"),
                        (state["at"] - kept["chars"]).alias("begin"), behind.alias("at"),
                        F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), at.alias("stop"), state["begin"].alias("begin"),
                                                                 state["words"].alias("words")))).alias("done"))))

            return let(F.get(p, at), place)

        start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("words"), lead.alias("begin"), lead.alias("at"),
                         F.array().cast("array<struct<first:int,stop:int,begin:int,words:int>>").alias("done"))
        runs = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, lambda state: F.concat(state["done"], F.array(F.struct(
            state["first"].alias("first"), F.size(p).alias("stop"), state["begin"].alias("begin"), state["words"].alias("words")))))

        def chunk(run: Column, no: Column) -> Column:
            inner = F.slice(p, run["first"] + 1, run["stop"] - run["first"] - 1)
            whole = F.concat(F.array_join(F.transform(inner, lambda x: F.concat(x["text"], x["tail"])), ""), F.get(p, run["stop"] - 1)["text"])

            def bare(body: Column) -> Column:
                text = F.ltrim(body, F.lit(WORD_SPACE))
                start_char = run["begin"] + F.length(body) - F.length(text)
                return let(F.rtrim(text, F.lit(WORD_SPACE)), lambda found: F.struct(
                    no.alias("chunk_no"), found.alias("text"), start_char.alias("start_char"),
                    (start_char + F.length(found)).alias("end_char"), run["words"].alias("n_words")))

            return let(whole, bare)

        return F.when(F.size(p) > 0, F.transform(runs, chunk)).otherwise(F.array().cast(NO_CHUNKS))

    return let(pieces, packed)


def _groups(tokens: Column, at: Column, stop: Column, size: int, lead: Column, tail: Column) -> Column:
    """Pieces of at most `size` words from the words `at` to `stop`; `lead` goes before the first and `tail` behind the last."""
    return F.transform(F.sequence(at, stop - 1, F.lit(size)), lambda i: F.struct(
        F.concat(F.when(i == at, lead).otherwise(""), F.array_join(F.slice(tokens, i + 1, F.least(F.lit(size), stop - i)), "")).alias("text"),
        F.when(i + size >= stop, tail).otherwise("").alias("tail"), F.least(F.lit(size), stop - i).alias("n")))


def sentence_array(text: Column, tokens: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_no, text, start_char, end_char, n_words): whole sentences packed into at most `size` words.

    A sentence ends with a word that ends in a full stop, exclamation or
    question mark; one of more than `size` words is cut.
    """
    n = F.size(tokens)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.rtrim(F.get(tokens, i - 1), F.lit(WORD_SPACE)).rlike(r"[.!?]$"))
    pieces = let(ends, lambda e: F.flatten(F.transform(e, lambda end, i: _groups(
        tokens, F.coalesce(F.get(e, i - 1), F.lit(0)), end, size, F.lit(""), F.lit("")))))
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(WORD_SPACE)))
    return F.when(n > 0, packed_runs(pieces, lead, size, overlap)).otherwise(F.array().cast(NO_CHUNKS))


def paragraph_run_array(text: Column, separator: str, size: int, overlap: int) -> Column:
    """Array of (chunk_no, text, start_char, end_char, n_words): whole paragraphs packed into at most `size` words.

    Words are those of the paragraphs; what separates two of one chunk is part
    of its text but not counted. A paragraph of more than `size` words is cut.
    """
    def pieces(parts: Column, gaps: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: has_text(F.get(parts, i)))

        def joined(first: Column, stop: Column) -> Column:
            """Separators from the one behind part `first` on, with the blank parts between them."""
            return F.array_join(F.transform(F.filter(F.sequence(first, stop - 1), lambda i: i < stop), lambda i: F.concat(
                F.when(i > first, F.get(parts, i)).otherwise(""), F.coalesce(F.get(gaps, i), F.lit("")))), "")

        def cut(i: Column, no: Column, places: Column) -> Column:
            behind = F.coalesce(F.get(places, no + 1), F.size(parts))
            return let(words(F.get(parts, i)), lambda tokens: _groups(
                tokens, F.lit(0), F.size(tokens), size,
                F.left(F.get(parts, i), F.length(F.get(parts, i)) - F.length(F.array_join(tokens, ""))), joined(i, behind)))

        return let(full, lambda places: F.flatten(F.transform(places, lambda i, no: cut(i, no, places))))

    def lead(parts: Column, gaps: Column) -> Column:
        """Characters before the first paragraph that is not blank."""
        lengths = F.transform(parts, lambda p, i: F.struct(has_text(p).alias("full"), (F.length(p) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0))).alias("n")))
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
        return F.aggregate(lengths, start, lambda s, x: F.when(s["open"] & ~x["full"], F.struct(
            (s["n"] + x["n"]).alias("n"), F.lit(True).alias("open"))).otherwise(s.withField("open", F.lit(False))), lambda s: s["n"])

    return let(F.struct(F.split(text, separator).alias("parts"), F.regexp_extract_all(text, F.lit(separator), F.lit(0)).alias("gaps")), lambda x: packed_runs(
        pieces(x["parts"], x["gaps"]), lead(x["parts"], x["gaps"]), size, overlap))


def chunk_paragraph_runs(df: DataFrame, separator: str = PARAGRAPH, size: int = 512, overlap: int = 20, text: str = "text") -> DataFrame:
    """One row per packed run of whole paragraphs, an exact substring of the text with its offsets; blank paragraphs count
    for nothing, and null and blank texts give no rows. Only a paragraph longer than `size` is cut."""
    _check(size, overlap)
    carried = [c for c in df.columns if c != text]
    return df.select(*carried, F.inline(paragraph_run_array(F.coalesce(F.col(text), F.lit("")), separator, size, overlap)))


def chunk_sentences(df: DataFrame, size: int = 512, overlap: int = 20, text: str = "text") -> DataFrame:
    """One row per packed run of whole sentences, an exact substring of the text; only a sentence longer than `size` is cut."""
    _check(size, overlap)
    carried = [c for c in df.columns if c != text]
    return (df.withColumn("_tokens", words(F.coalesce(F.col(text), F.lit(""))))
            .select(*carried, F.inline(sentence_array(F.col(text), F.col("_tokens"), size, overlap))))


def markdown_array(text: Column) -> Column:
    """Array of (section_no, level, heading, header_path, text) for one markdown text.

    Cutting before the fence lines (three backticks or tildes) leaves fenced
    pieces at odd places, so headings are only marked in the even ones.
    `header_path` lists the enclosing headings.
    """
    mark = "\x01\x02\x03\x02\x01"
    pieces = F.split(F.concat(F.lit("\n"), text), r"(?<=\n)(?=```|~~~)")
    marked = F.array_join(F.transform(pieces, lambda piece, i: F.when(
        i % 2 == 0, F.regexp_replace(piece, r"(?<=\n)(?=#{1,6}[ \t])", mark)).otherwise(piece)), "")
    sections = F.filter(F.transform(F.split(marked, mark), lambda s: F.trim(s, F.lit(" \t\r\n"))), lambda s: s != "")

    def describe(section):
        hashes = F.regexp_extract(section, r"^(#{1,6})[ \t]", 1)
        return F.struct(
            F.length(hashes).alias("level"),
            F.trim(F.regexp_extract(section, r"^#{1,6}[ \t]+([^\n]*)", 1), F.lit(" \t\r")).alias("heading"),
            section.alias("text"))

    blank = F.array_repeat(F.lit(""), 6)

    def step(state, section):
        level = section["level"]
        path = F.array_join(F.filter(F.slice(state["open"], 1, F.greatest(level - 1, F.lit(0))), lambda h: h != ""), "/")
        opened = F.when(level == 0, state["open"]).otherwise(F.transform(
            state["open"],
            lambda h, i: F.when(i + 1 < level, h).when(i + 1 == level, section["heading"]).otherwise("")))
        done = F.concat(state["done"], F.array(F.struct(
            F.size(state["done"]).alias("section_no"), level.alias("level"), section["heading"].alias("heading"),
            path.alias("header_path"), section["text"].alias("text"))))
        return F.struct(opened.alias("open"), done.alias("done"))

    empty = F.array().cast("array<struct<section_no:int,level:int,heading:string,header_path:string,text:string>>")
    return F.aggregate(F.transform(sections, describe), F.struct(blank.alias("open"), empty.alias("done")),
                       step, lambda state: state["done"])


def split_markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per markdown section. A `#` line inside a code fence starts no section."""
    carried = [c for c in df.columns if c != text]
    return df.select(*carried, F.inline(markdown_array(F.col(text))))
