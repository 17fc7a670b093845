"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docflow.functions.vectors import let
from docflow.llm.registry import query, table
from docflow.llm.rows import with_row_key

#: Samples of a fingerprint, in blocks that are aggregated as one row each.
BLOCKS, BLOCK_SAMPLES = 3, 8
SAMPLES = BLOCKS * BLOCK_SAMPLES
#: Stretches of ids that documents are ordered in, at most; a stretch has about `STRETCH_ROWS` if there are fewer.
STRETCHES, STRETCH_ROWS = 1 << 16, 64


def weighted_terms(text: Column) -> Column:
    """Hash `x` and number of times `n` of each different word: the runs of the sorted word hashes."""
    hashes = F.sort_array(F.array_remove(F.transform(F.split(text, r"\s+"), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    none = F.array().cast("array<struct<x:bigint,n:int>>")

    def runs(h: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.get(h, i) != F.get(h, i - 1)))
        return let(last, lambda ends: F.transform(ends, lambda e, j: F.struct(
            F.get(h, e - 1).alias("x"), (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("n"))))

    return let(hashes, lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(none))


def _uniform(bits: Column, low: int) -> Column:
    """Number between 0 and 1 from twelve bits, never either."""
    return (F.shiftright(bits, low).bitwiseAND(4095) + 0.5) / 4096.0


def _sample(bits: Column, log_weight: Column) -> Column:
    """The race value of a term in one sample, above 32 bits that name the term and its quantised weight.

    r and c are Gamma(2, 1), beta is uniform, all given by term and sample
    alone. The weight is rounded down to y = exp(r (t - beta)) for a whole t,
    and the term with the least c / (y exp(r)) is the sample. Two weighted sets
    agree in it with the probability of their generalised Jaccard similarity.
    """
    r = -F.log(_uniform(bits, 0) * _uniform(bits, 12))
    log_c = F.log(-F.log(_uniform(bits, 24) * _uniform(bits, 36)))
    beta = F.shiftrightunsigned(bits, 48) / 65536.0
    t = F.floor(log_weight / r + beta)
    race = ((log_c - r * (t - beta + 1) + 64) * (1 << 23)).cast("long")
    return F.shiftleft(race, 32).bitwiseOR(F.shiftrightunsigned(bits, 32).bitwiseXOR(t * 40503).bitwiseAND(0xFFFFFFFF))


def signatures(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and `signature`, an array of `SAMPLES` numbers of 32 bits, for each row that has words.

    `keys` name a row. Terms are counted within the row; only samples leave it.
    """
    terms = rows.select(*keys, F.inline(weighted_terms(F.col(text)))).select(
        *keys, "x", F.log("n").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_b"))
    drawn = terms.select(*keys, "_b", "w", *[F.xxhash64("x", F.col("_b") * BLOCK_SAMPLES + i).alias(f"h{i}") for i in range(BLOCK_SAMPLES)])
    least = drawn.groupBy(*keys, "_b").agg(*[F.min(_sample(F.col(f"h{i}"), F.col("w"))).alias(f"m{i}") for i in range(BLOCK_SAMPLES)])
    blocks = least.select(*keys, F.struct("_b", F.array(*[
        F.col(f"m{i}").bitwiseAND(0xFFFFFFFF).alias(f"m{i}") for i in range(BLOCK_SAMPLES)]).alias("s")).alias("_s"))
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(
        *keys, F.flatten(F.col("_s.s")).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that agree; texts without words are alike, and unlike all others."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(SAMPLES)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(agree)


def fingerprint(signature: Column) -> Column:
    """Signature as text; empty for texts without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), ""), F.lit(""))


def _numbers(values: list, kind: str) -> Column:
    """A constant array. Written as one string, which the optimizer turns into the array once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _stretch(bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above `_id`, by halving; -1 for null.

    The steps are one lambda and not a projection each: Spark writes out projections that read each other, at the power of
    their number, wherever it follows a column down to its table.
    """
    held = _numbers(bounds, "bigint")

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= len(bounds)) & (F.get(held, at + width - 1) <= F.col("_id")), at + width).otherwise(at)

    widths = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(_numbers(widths, "int"), F.lit(0), step)
    return F.when(F.col("_id").isNull(), -1).otherwise(F.coalesce(found, F.lit(0)))


def in_stretches(docs: DataFrame, id_col: str, text_col: str, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Rows with the stretch of ids they lie in (`_s1`, `_s2`) and their place in it from the largest id on (`_no`).

    Stretches are bounded by quantiles of the ids, so they have about as many
    rows each, however the ids are spread. An id with more rows than that is a
    stretch by itself, cut again by row key (`_s2`) into as many as it fills;
    so are null ids, which come last.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    total, n = ids.agg(F.count("*"), F.count("_id")).first()
    stretches = min(STRETCHES, max(1, n // stretch_rows))
    found = ids.agg(F.percentile_approx("_id", _numbers([i / stretches for i in range(1, stretches)], "double"), F.lit(10 * stretches))
                    ).first()[0] if stretches > 1 else []
    often = {a for a, b in zip(found, found[1:]) if a == b}
    bounds = sorted({*found, *(a + 1 for a in often if a < 2**63 - 1)})
    place = {b: i + 1 for i, b in enumerate(bounds)}
    cuts = [0] * (len(bounds) + 1)
    for a in found:
        cuts[place[a]] += a in often
    cuts = [min(4096, max(1, c)) for c in cuts]
    nulls = min(4096, max(1, (total - n) // stretch_rows))
    rows = with_row_key(ids, "_id", "_text").withColumn("_s1", _stretch(bounds))
    times = F.when(F.col("_id").isNull(), nulls).otherwise(F.get(_numbers(cuts, "int"), F.col("_s1")))
    # Neither is null by its type: a join would otherwise test it for null in one copy of the plan and share no shuffle with the others.
    rows = rows.withColumn("_s2", F.coalesce(F.floor((F.shiftright("_r1", 52) + 2048) * times / 4096), F.lit(0)))
    order = W.partitionBy("_s1", "_s2").orderBy(F.desc_nulls_last("_id"), F.desc("_r1"), F.desc("_r2"))
    return rows.select("_id", "_text", "_s1", "_s2", F.row_number().over(order).alias("_no"),
                       F.lead("_text").over(order).alias("_next"))


def chain(rows: DataFrame) -> DataFrame:
    """Per stretch (`_s1`, `_s2`) the next one downwards (`_d1`, `_d2`); after the last comes the first.

    `rows` needs no more than the stretches; there are at most three times
    `STRETCHES` of them and 4096 of null ids, so one task can order them.
    """
    stretches = rows.select("_s1", "_s2").distinct()
    order = W.orderBy(F.desc("_s1"), F.desc("_s2"))
    down = F.struct("_s1", "_s2")
    return stretches.select("_s1", "_s2", F.lead(down).over(order).alias("_d"), F.first(down).over(order).alias("_f")).select(
        "_s1", "_s2", F.coalesce("_d", "_f").alias("_d"))


def with_next(rows: DataFrame, links: DataFrame, value: str, following: str, name: str) -> DataFrame:
    """Fill `following`, the value of the next row of the same stretch, for the last rows of stretches.

    Only the first row of each stretch travels, to the stretch before it.
    """
    heads = rows.filter("_no = 1").select("_s1", "_s2", F.col(value).alias("_head"))
    heads = heads.join(links.select(F.col("_s1").alias("_u1"), F.col("_s2").alias("_u2"), F.col("_d._s1").alias("_s1"), F.col("_d._s2").alias("_s2")),
                       ["_s1", "_s2"]).select("_u1", "_u2", "_head")
    last = (F.col("_s1") == F.col("_u1")) & (F.col("_s2") == F.col("_u2")) & F.col("_last")
    return rows.join(heads, last, "left").withColumn(name, F.when(F.col("_last"), F.col("_head")).otherwise(F.col(following))).drop(
        "_u1", "_u2", "_head")


def near_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its end replaced by the next document's beginning.

    The last floor(n_chars / 2) code points give way to as many, or all, of the
    next document by descending id; null ids come last, equal ids go by a hash
    of the text, and after the last row comes the first. Null texts are empty;
    each repeated row is a document of its own. Texts without words have the
    empty fingerprint, are alike and unlike all others.

    The texts are moved once, to their stretch of ids.
    """
    rows = in_stretches(docs, id_col, text_col).withColumns({"_n": F.length("_text"), "_last": F.col("_next").isNull()})
    links = chain(rows)
    rows = with_next(rows, links, "_text", "_next", "_after")
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.left("_text", F.col("_n") - half), F.left("_after", half))
    key = ["_s1", "_s2", "_no"]
    rows = rows.select(*key, "_id", "_n", "_last", "_text", edited.alias("_edited"))
    both = rows.select(*key, F.posexplode(F.array("_text", "_edited")).alias("_which", "_t"))
    drawn = signatures(both, [*key, "_which"], "_t").groupBy(*key).agg(
        F.first(F.when(F.col("_which") == 0, F.col("signature")), True).alias("_own"),
        F.first(F.when(F.col("_which") == 1, F.col("signature")), True).alias("_other"))
    told = rows.select(*key, "_id", "_n", "_last", F.sha2("_edited", 256).alias("_sha"))
    found = told.join(drawn, key, "left")
    order = W.partitionBy("_s1", "_s2").orderBy("_no")
    found = found.withColumn("_following", F.lead("_own").over(order))
    found = with_next(found, links, "_own", "_following", "_after")
    return found.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
                        fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_other")).alias("edited_fingerprint"),
                        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
                        likeness(F.col("_own"), F.col("_after")).alias("near_next"))


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_edits(table(spark, sf_dir, "documents"))
