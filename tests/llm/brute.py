"""Plain Python versions of the operators, and rows that are hard to get right."""

from __future__ import annotations

import random

LETTERS = "abcdefgh"


def near(a: str, b: str) -> bool:
    """One insertion, deletion or substitution at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def words(seed: int, n: int, vocabulary: int = 500) -> list[str]:
    source = random.Random(seed)
    pool = ["".join(source.choice(LETTERS) for _ in range(source.randint(2, 8))) for _ in range(vocabulary)]
    return [source.choice(pool) for _ in range(n)]


def edge_rows(spark, rows, extra: bool = True):
    """Rows of (doc_id, text) as a table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"_r1": F.lit("x"), "_line": F.lit(1), "ids": F.lit("y"), "score": F.lit(2.0)}) if extra else df
