"""Lines that repeat, or nearly repeat, an earlier line of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docflow.functions.vectors import let
from docflow.llm.registry import query, table
from docflow.llm.rows import tabled, with_row_key

#: Lines of fewer characters are only compared as a whole: one edit would make them another line.
NEAR_CHARS = 20
GRID = 1.1
#: Candidate lines whose keys and places (seven numbers) are sent to all tasks; more are joined by a shuffle.
SENT_ROWS = 100_000


def _half(length: Column) -> Column:
    """Characters that are certainly untouched on one side when a line of this length has one edit.

    Rounded down on a geometric grid, so that lines whose lengths differ by one mostly agree.
    """
    half = F.floor((length - 1) / 2)
    step = F.lit(GRID)
    return F.least(half, F.greatest(F.lit(1), F.floor(F.pow(step, F.floor(F.log(half.cast("double")) / F.log(step))))))


def _ends(line: Column, size: Column) -> Column:
    return F.array(F.xxhash64(F.lit("left"), size, F.substring(line, F.lit(1), size)),
                   F.xxhash64(F.lit("right"), size, F.right(line, size)))


def _lines(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line that is not blank, with its place and its keys."""
    rows = base.select("_r1", "_r2", F.col(id_col).alias("_id"),
                       F.posexplode(F.split(F.col(text_col), "\n")).alias("_no", "_line"))
    rows = rows.filter(F.trim("_line") != "").withColumn("_n", F.length("_line"))
    rows = rows.withColumns({"_g": _half(F.col("_n")), "_g1": _half(F.col("_n") - 1)})
    near = F.when(F.col("_n") < NEAR_CHARS, F.array().cast("array<bigint>")).when(
        F.col("_g") == F.col("_g1"), _ends(F.col("_line"), F.col("_g"))).otherwise(
            F.concat(_ends(F.col("_line"), F.col("_g")), _ends(F.col("_line"), F.col("_g1"))))
    return rows.select(F.struct("_id", "_r1", "_r2", "_no").alias("_place"), F.xxhash64("_line").alias("_k1"),
                       F.xxhash64(F.lit(5), "_line", "_n").alias("_k2"), near.alias("_ends"))


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys under which two different lines lie."""
    both = rows.groupBy(*key).agg(F.min("_k1").alias("_lo"), F.max("_k1").alias("_hi"))
    return both.filter(F.col("_lo") != F.col("_hi")).select(*key)


def _without_block(lines: DataFrame) -> DataFrame:
    """Each line without one block of about the root of its length, and that block.

    `_m` is the shorter length of a pair the line may belong to: its own, or
    one less. Blocks start at the same characters in all lines with that `_m`,
    counted from the left before the block and from the right behind it.
    """
    sized = lines.select("*", F.explode(F.array(F.length("_line"), F.length("_line") - 1)).alias("_m"))
    sized = sized.withColumn("_b", F.ceil(F.sqrt("_m")).cast("int"))
    sized = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / F.col("_b")).cast("int"))).alias("_j"))
    before = F.col("_j") * F.col("_b")
    behind = F.greatest(F.col("_m") - before - F.col("_b"), F.lit(0))
    return sized.select(
        "_k1", "_k2", "_place", "_m", "_j", (F.length("_line") == F.col("_m")).alias("_whole"),
        F.xxhash64(F.substring(F.col("_line"), F.lit(1), before), F.lit("|"),
                   F.when(behind > 0, F.right("_line", behind)).otherwise("")).alias("_rest"),
        F.substring(F.col("_line"), before + 1, F.length("_line") - before - behind).alias("_block"))


def _variants(blocks: DataFrame) -> DataFrame:
    """Each block without one character, as hashed keys, and the blocks of the shorter lines as they are.

    Lines of one length are a substitution apart if they agree without the
    character at one place (`_at`); a shorter line is a deletion away from a
    longer one if its block is the longer one's without some character.
    """
    def drop(i: Column) -> Column:
        return F.concat(F.substring(F.col("_block"), F.lit(1), i), F.substring(F.col("_block"), i + 2, F.length("_block")))

    places = F.sequence(F.lit(0), F.length("_block") - 1)
    at = F.when(F.col("_whole"), F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(drop(i)).alias("v"))))
    less = F.transform(places, lambda i: F.struct(F.lit(-1).alias("at"), F.xxhash64(drop(i)).alias("v")))
    own = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64("_block").alias("v")))
    blocks = blocks.filter(F.length("_block") > 0)
    return blocks.select("_k1", "_k2", "_place", "_m", "_j", "_rest", "_whole", F.explode(
        F.when(F.col("_whole"), F.concat(at, own)).otherwise(F.array_distinct(less))).alias("_x")).select(
            "_k1", "_k2", "_place", "_whole", F.xxhash64("_m", "_j", "_rest", "_x.at", "_x.v").alias("_v1"),
            F.xxhash64("_x.v", "_rest", "_m", "_j", "_x.at").alias("_v2"), (F.col("_x.at") >= 0).alias("_same"))


def _repeats(base: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """First place of each different line, and the lines that lie within one edit of an earlier line."""
    firsts = tabled(_lines(base, id_col, text_col).groupBy("_k1", "_k2").agg(
        F.min("_place").alias("_place"), F.first("_ends").alias("_ends")), "lines")
    ends = firsts.select("_k1", "_k2", F.explode("_ends").alias("_end"))
    candidates = ends.join(_shared(ends, ["_end"]), "_end", "left_semi").select("_k1", "_k2").distinct()
    places = tabled(firsts.select("_k1", "_k2", "_place").join(candidates, ["_k1", "_k2"]), "candidates")
    # The text of a candidate is read where it first stands; a document's candidates travel together.
    by_doc = places.groupBy(F.col("_place._r1").alias("_r1"), F.col("_place._r2").alias("_r2")).agg(
        F.collect_list(F.struct("_place", "_k1", "_k2")).alias("_found"))
    by_doc = F.broadcast(by_doc) if places.limit(SENT_ROWS + 1).count() <= SENT_ROWS else by_doc
    texts = base.select("_r1", "_r2", text_col)
    lines = tabled(texts.join(by_doc, ["_r1", "_r2"]).select(F.explode(
        let(F.split(F.col(text_col), "\n"), lambda all_: F.transform("_found", lambda f: F.struct(
            f["_place"].alias("_place"), f["_k1"].alias("_k1"), f["_k2"].alias("_k2"),
            F.get(all_, f["_place"]["_no"]).alias("_line"))))).alias("_f")).select("_f.*").dropDuplicates(["_k1", "_k2"]), "candidate-lines")
    blocks = _without_block(lines)
    variants = tabled(_variants(blocks.join(_shared(blocks, ["_m", "_j", "_rest"]), ["_m", "_j", "_rest"], "left_semi")), "variants")
    who = F.struct("_place", "_k1", "_k2")
    # One group is one line with any character at one place, or one line and those a character longer.
    # So its earliest line, or that one line, stands for all its pairs.
    groups = variants.groupBy("_v1", "_v2").agg(
        F.min(F.when(F.col("_same") | ~F.col("_whole"), who)).alias("_early"),
        F.min(F.when(~F.col("_same") & F.col("_whole"), who)).alias("_short"))
    pairs = variants.join(groups, ["_v1", "_v2"]).select(
        who.alias("_late"), F.when(F.col("_same") | F.col("_whole"), F.col("_early")).otherwise(F.col("_short")).alias("_early"))
    pairs = pairs.filter(F.col("_early._place") < F.col("_late._place")).distinct()
    text = lines.select("_k1", "_k2", "_line")
    checked = (tabled(pairs, "pairs").join(text.select(F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2"), F.col("_line").alias("_a")),
                          (F.col("_late._k1") == F.col("_a1")) & (F.col("_late._k2") == F.col("_a2")))
               .join(text.select(F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2"), F.col("_line").alias("_b")),
                     (F.col("_early._k1") == F.col("_b1")) & (F.col("_early._k2") == F.col("_b2")))
               .filter((F.levenshtein("_a", "_b", 1) >= 0)))
    return firsts, checked.select(F.col("_late._k1").alias("_k1"), F.col("_late._k2").alias("_k2")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without lines that repeat an earlier line, with `n_lines` and `n_removed`.

    Earlier is by id (null first), then a hash of the text, then line number.
    A line goes if the same line stands earlier, or, from `NEAR_CHARS`
    characters on, if one within a single insertion, deletion or substitution
    of a character stands earlier, whether or not that one itself stays. Blank
    lines stay and never count. Rows that agree in id and text are one
    document and each get its result. A null text has no lines and stays null.
    The caller's columns are handed through, but for those that bear the name
    of a result.

    Variants are only made of lines that have an exact partner for half of
    their characters (one edit leaves one half alone); then one block of a line
    is left out, and only within blocks whose rest agrees single characters.
    """
    others = [c for c in docs.columns if c != text_col and c not in ("n_lines", "n_removed")]
    base = with_row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                                    F.col(f"`{text_col}`").alias("_text")), "_id", "_text")
    firsts, near = _repeats(base, "_id", "_text")
    kept = firsts.join(near, ["_k1", "_k2"], "left_anti").groupBy(
        F.col("_place._r1").alias("_r1"), F.col("_place._r2").alias("_r2")).agg(
            F.sort_array(F.collect_list("_place._no")).alias("_kept"))
    none = F.array().cast("array<int>")
    cut = let(F.split("_text", "\n"), lambda all_: let(
        F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.trim(F.get(all_, i)) == ""), lambda blank: F.struct(
            F.array_join(F.transform(F.array_sort(F.concat(F.coalesce("_kept", none), blank)), lambda i: F.get(all_, i)),
                         "\n").alias("text"),
            F.size(all_).alias("n"),
            (F.size(all_) - F.size(blank) - F.size(F.coalesce("_kept", none))).alias("removed"))))
    out = base.join(kept, ["_r1", "_r2"], "left").withColumn("_cut", cut)
    return out.select(*[F.col("_cut.text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c in (*others, text_col)],
                      F.coalesce("_cut.n", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce("_cut.removed", F.lit(0)).cast("long").alias("n_removed"))


# One edit leaves the first or the last ten characters of a line of twenty as they are.
@query("op10_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
f AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + no) AS place FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
pairs AS (SELECT a.line AS a, b.line AS b FROM f a JOIN f b ON left(a.line, 10) = left(b.line, 10)
            AND a.place > b.place AND a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1
          UNION SELECT a.line, b.line FROM f a JOIN f b ON right(a.line, 10) = right(b.line, 10)
            AND a.place > b.place AND a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT a AS line FROM pairs WHERE len(list_filter(range(0, length(a) + 1), lambda i:
  left(a, i) = left(b, i) AND (substr(a, i + 2) = substr(b, i + 2) OR substr(a, i + 1) = substr(b, i + 2) OR substr(a, i + 2) = substr(b, i + 1)))) > 0),
k AS (SELECT l.*, f.line IS NOT NULL AND (place <> doc_id * 1000000 + no OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
