"""Fill-in-middle forms of documents, cut at units that a learned rank index finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.functions.vectors import let
from docflow.llm.registry import query, table
from docflow.llm.rows import with_row
from docflow.llm.words import by_bytes, strings, thrifty

#: Marks of the forms (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that a segment's prediction may be off; a residual takes one signed byte.
ERROR = 100
#: Per cent of the documents that stay plain, and of the others that get the suffix first (fixed values).
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20


class RankIndex:
    """From the rank of a boundary to its offset: lines with a bounded error, and what each is off.

    `offsets` holds the boundaries of all texts behind each other, `starts` the
    first one of each text. A text begins as one line from its first to its
    last boundary; lines that are off by more than `error` somewhere are
    halved, until none is. A line of two boundaries is always exact, so the
    halving ends, after as many rounds as the longest text has binary digits.
    """

    def __init__(self, offsets: np.ndarray, starts: np.ndarray, error: int = ERROR):
        self.residual = np.zeros(len(offsets), np.int8)
        done, first, last = [], starts[:-1], starts[1:] - 1
        while len(first):
            slope = (offsets[last] - offsets[first]) / np.maximum(last - first, 1)
            sizes = last - first + 1
            begins = np.cumsum(sizes) - sizes
            ranks = np.arange(int(sizes.sum())) - np.repeat(begins - first, sizes)
            off = offsets[ranks] - self._line(offsets[first], slope, first, np.repeat(np.arange(len(first)), sizes), ranks)
            fits = np.maximum.reduceat(np.abs(off), begins) <= error
            good = np.repeat(fits, sizes)
            self.residual[ranks[good]] = off[good]
            done.append((first[fits], offsets[first[fits]], slope[fits]))
            first, last = first[~fits], last[~fits]
            half = (first + last) // 2
            first, last = np.concatenate([first, half + 1]), np.concatenate([half, last])
        parts = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3)]
        order = np.argsort(parts[0])
        self.first, self.base, self.slope = (p[order] for p in parts)

    @staticmethod
    def _line(base: np.ndarray, slope: np.ndarray, first: np.ndarray, segment: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return base[segment] + np.floor(slope[segment] * (ranks - first[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries with these ranks."""
        segment = np.searchsorted(self.first, ranks, "right") - 1
        return self._line(self.base, self.slope, self.first, segment, ranks) + self.residual[ranks]


def unit_starts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a unit begins, runs of ASCII letters or single other characters, and the unit that each text begins with."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[starts[:-1][np.diff(starts) > 0]] = True
    places = np.flatnonzero(begins)
    return places, np.searchsorted(places, starts)


def boundaries(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in its text of every boundary, 0 and the length included, and the first boundary of each text."""
    places, first_unit = unit_starts(raw, starts)
    counts = np.diff(first_unit)
    first = first_unit + np.arange(len(first_unit))
    offsets = np.zeros(int(first[-1]), np.int64)
    at = np.arange(len(places)) + np.repeat(np.arange(len(counts)), counts)
    offsets[at] = places - np.repeat(starts[:-1], counts)
    offsets[first[1:] - 1] = np.diff(starts)
    return offsets, first


def _cut(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    starts = bounds - bounds[0]
    offsets, first = boundaries(raw, starts)
    index, units = RankIndex(offsets, first), np.diff(first) - 1
    draws = [np.asarray(part.column(i)).astype(np.int64) for i in range(2, 6)]
    one, two = draws[0] % (units + 1), draws[1] % (units + 1)
    cuts = [index.offsets(first[:-1] + rank) for rank in (np.minimum(one, two), np.maximum(one, two))]
    marked = np.any([np.asarray(pc.match_substring(texts, mark)) for mark in (PREFIX, SUFFIX, MIDDLE)], axis=0)
    plain = (units == 0) | marked | (draws[2] % 100 >= 100 - PLAIN_PERCENT)
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = [leads[starts[:-1] + cuts[0]] - leads[starts[:-1]], leads[starts[:-1] + cuts[1]] - leads[starts[:-1] + cuts[0]]]
    forms = np.where(plain, "plain", np.where(draws[3] % 100 < SUFFIX_FIRST_PERCENT, "spm", "psm"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    content, out = raw.tobytes(), []
    for form, a, b, begin, end in zip(forms.tolist(), cuts[0].tolist(), cuts[1].tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        prefix, middle, suffix = content[begin:begin + a], content[begin + a:begin + b], content[begin + b:end]
        out.append(content[begin:end] if form == "plain" else b"".join([p, prefix, s, suffix, m, middle] if form == "psm"
                                                                        else [s, suffix, p, prefix, m, middle]))
    return pa.record_batch([part.column(0), pa.array(units, pa.int64()), pa.array(forms.tolist(), pa.string()),
                            *[pa.array(c, pa.int64(), mask=plain) for c in chars],
                            pa.array(out, pa.large_binary()).cast(pa.large_string())],
                           names=["_row", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """The documents' other columns with `n` (units), `form`, `prefix_chars`, `middle_chars` and `output`.

    Units are runs of ASCII letters and single other characters. Two ranks drawn
    by a hash of seed and id cut a text into prefix, middle and suffix; `form`
    says how `output` orders them: `psm`, `spm`, or `plain` (the text itself)
    for empty texts, texts that hold a mark, and a tenth drawn by the id.

    A null text is empty. A null id is drawn like an empty one; rows that agree
    in id are cut at the same draws. Every row gives one row. The caller's
    columns are handed through, but for those that bear the name of a result.

    All work stays inside the row: no shuffle, and texts are cut in slices of
    bounded bytes, one text at least.
    """
    names = {"n", "form", "prefix_chars", "middle_chars", "output"}
    others = [c for c in docs.columns if c != text_col and c not in names]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draws = let(digest, lambda d: F.transform(F.array(*[F.lit(1 + 8 * i) for i in range(4)]), lambda at: F.conv(
        F.substr(d, at, F.lit(8)), 16, 10).cast("long")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text_col}`").alias("_text"),
                       draws.alias("_draws"))
    rows = rows.select("_row", "_text", *[F.get("_draws", i).alias(f"_h{i}") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for at, stop in by_bytes(texts):
                yield _cut(batch.slice(at, stop - at), texts.slice(at, stop - at))

    made = rows.mapInArrow(thrifty(run), with_row(rows, "n long, form string, prefix_chars long, middle_chars long, output string"))
    return made.select(*[F.col(f"_row.`{c}`") for c in others], *[c for c in made.columns if c != "_row"])


def restored(output: Column, form: Column) -> Column:
    """The text again. A text with a mark is plain, so the first of each mark is where a part ends."""
    def parts(rest: Column, mark: str, use) -> Column:
        """`use(part before the mark, what comes behind it)`."""
        return let(F.struct(F.substring_index(rest, mark, 1).alias("a"), rest.alias("r")),
                   lambda x: use(x["a"], F.substr(x["r"], F.length(x["a"]) + len(mark) + 1)))

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = parts(body, SUFFIX, lambda prefix, rest: parts(rest, MIDDLE, lambda suffix, middle: F.concat(prefix, middle, suffix)))
    spm = parts(body, PREFIX, lambda suffix, rest: parts(rest, MIDDLE, lambda prefix, middle: F.concat(prefix, middle, suffix)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query("op12_fill_in_middle", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::bigint AS h1, ('0x' || substr(d, 9, 8))::bigint AS h2,
             ('0x' || substr(d, 17, 8))::bigint AS h3, ('0x' || substr(d, 25, 8))::bigint AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
             array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
