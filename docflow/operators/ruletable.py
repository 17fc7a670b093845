"""Rules as a table: thousands of patterns meet the keys by a join on a piece of literal text, whatever their number."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docflow.operators.joins import skew_join
from docflow.operators.rules import java_pattern, valid_patterns

#: Characters of the pieces that rules and keys are joined by.
GRAM = 3
#: Rules of a table, which are checked on the driver and sent to all tasks, and those of them without a piece to join by.
MOST_RULES, MOST_LOOSE = 100_000, 500
#: Characters whose pieces are looked up together, and bits by which most pieces that no rule has are told at once.
TOGETHER, SLOT_BITS = 1 << 20, 20


def literal_runs(pattern: str) -> list[str]:
    """Texts that every match of the pattern contains. None for patterns with groups, choices or flags."""
    if re.search(r"(?<!\\)(?:\\\\)*[(|]", pattern):
        return []
    runs, now = [], ""
    for m in re.finditer(r"\\([A-Za-z0-9])|\\(.)|\[\^?\]?(?:\\.|[^\]\\])*\]|(\{[^}]*\}|[?*])|([+])|([.^$])|(.)", pattern, re.S):
        escape, quoted, optional, again, other, plain = m.groups()
        if quoted is not None or plain is not None:
            now += quoted if quoted is not None else plain
            continue
        # What a quantifier makes optional is in no run; what it repeats may end one.
        runs.append(now[:-1] if optional is not None else now)
        now = ""
    return [r for r in [*runs, now] if r]


def _stretches(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and their texts, about `TOGETHER` characters at a time; longer texts are cut so that no piece is lost."""
    rows, parts, size = [], [], 0
    for row, content in enumerate(texts.cast(pa.binary()).to_pylist()):
        text = content.decode("utf-8", "replace")
        for at in range(0, len(text) - GRAM + 1, TOGETHER):
            rows.append(row)
            parts.append(text[at:at + TOGETHER + GRAM - 1])
            size += len(parts[-1])
            if size >= TOGETHER:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _codes(parts: list[str]) -> np.ndarray:
    """The piece at each place of the texts behind each other, as a number; a text's last ones reach into the next text."""
    letters = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = np.zeros(len(letters) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        codes = codes << np.uint64(21) | letters[j:j + len(codes)]
    return codes


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _coded(grams: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Pieces as sorted numbers, and themselves in that order."""
    codes = _codes(grams)[::GRAM] if grams else np.zeros(0, np.uint64)
    order = np.argsort(codes)
    return codes[order], pa.array(grams, pa.string()).take(pa.array(order))


def _times(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """`gram`, `n`: how often the keys have each of the pieces, if they do."""
    wanted, names = _coded(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, parts in _stretches(batch.column(0)):
                codes, n = np.unique(_codes(parts), return_counts=True)
                at = np.searchsorted(codes, wanted).clip(max=len(codes) - 1)
                times += np.where(codes[at] == wanted, n[at], 0)
        there = np.flatnonzero(times)
        yield pa.record_batch([names.take(pa.array(there)), pa.array(times[there])], names=["gram", "n"])

    return keyed.select("_key").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _found(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """`_g`, `gram`: which of the pieces each key has."""
    wanted, names = _coded(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << SLOT_BITS, bool)
        known[_slots(wanted)] = True
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for rows, parts in _stretches(batch.column(1)):
                codes = _codes(parts)
                places = np.flatnonzero(known[_slots(codes)])
                at = np.searchsorted(wanted, codes[places])
                of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                real = (of[places] == of[places + GRAM - 1]) & (wanted[at.clip(max=len(wanted) - 1)] == codes[places])
                both = np.unique(of[places[real]] * len(wanted) + at[real])
                yield pa.record_batch([pa.array(keys[np.array(rows)[both // len(wanted)]]), names.take(pa.array(both % len(wanted)))],
                                      names=["_g", "gram"])

    if not grams:
        return keyed.select("_g", F.lit("").alias("gram")).limit(0)
    return keyed.select("_g", "_key").mapInArrow(run, "_g long, gram string")


def apply_rule_table(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """The rows that `apply_rules` keeps, for rules (`pattern`, `exclude`) that come as a table of up to `MOST_RULES` rows.

    A row is kept if no rule with `exclude` is found in its key and, if there
    is a valid rule without, at least one such rule is. Keys are searched, a
    missing one is the empty string, and invalid patterns are reported and
    skipped. Null patterns and repeated rules count for nothing.

    Each rule is known by the rarest piece of text that all its matches
    contain, and only keys with that piece are searched for it; rules without
    such a piece, `MOST_LOOSE` at most, are searched in every key. The plan
    does not grow with the rules. Rules are read and the pieces of all keys
    counted when this is called; of the counts, a piece per rule comes back.
    """
    spark = df.sparkSession
    given = rules.select("pattern", F.coalesce("exclude", F.lit(False)).alias("exclude")).filter("pattern is not null").distinct()
    listed = given.limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    valid = set(valid_patterns(sorted({r.pattern for r in listed})))
    kept = [(r.pattern, r.exclude) for r in listed if r.pattern in valid]
    pieces = {p: sorted({run[i:i + GRAM] for run in literal_runs(p) for i in range(len(run) - GRAM + 1)}) for p, _ in kept}
    loose = [{"exclude": e, "regex": java_pattern(p)} for p, e in kept if not pieces[p]]
    if len(loose) > MOST_LOOSE:
        raise ValueError(f"more than {MOST_LOOSE} rules without {GRAM} letters that every match has")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("_row"), F.coalesce(F.col(f"`{key}`"), F.lit("")).alias("_key")).withColumn("_g", F.xxhash64("_key"))
    anchored = spark.createDataFrame([(i, e, java_pattern(p), pieces[p]) for i, (p, e) in enumerate(kept) if pieces[p]],
                                     "no int, exclude boolean, regex string, pieces array<string>")
    wanted = anchored.select("no", F.explode("pieces").alias("gram"))
    times = _times(keyed, sorted({g for own in pieces.values() for g in own}))
    rarest = wanted.join(F.broadcast(times), "gram").groupBy("no").agg(F.count("*").alias("n_pieces"), F.min(F.struct("n", "gram")).alias("a"))
    # A rule with a piece that no key has is found nowhere.
    chosen = rarest.join(anchored, "no").filter(F.col("n_pieces") == F.size("pieces")).select(
        F.col("a.gram").alias("gram"), F.struct("exclude", "regex").alias("_rule"))
    listed = chosen.collect()
    anchors = spark.createDataFrame(listed, chosen.schema)
    found = _found(keyed, sorted({r.gram for r in listed}))
    candidates = found.join(F.broadcast(anchors), "gram").groupBy("_g").agg(F.collect_set("_rule").alias("_rules"))
    always = F.from_json(F.lit(json.dumps(loose)), "array<struct<exclude:boolean,regex:string>>")
    searched = skew_join(keyed, candidates, "_g", "left").withColumn("_rules", F.concat(always, F.coalesce(
        "_rules", F.array().cast("array<struct<exclude:boolean,regex:string>>"))))

    def any_of(exclude: bool) -> Column:
        return F.exists("_rules", lambda r: (r["exclude"] == exclude) & F.rlike(F.col("_key"), r["regex"]))

    keep = ~any_of(True)
    if any(not e for _, e in kept):
        keep = keep & any_of(False)
    return searched.filter(keep).select(*[F.col(f"_row.`{c}`") for c in df.columns])
