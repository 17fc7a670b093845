"""Vector columns: feature hashing and normalisation as plain projections."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from docflow.functions.text import bare_words


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often a lambda inside reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Word counts per md5 bucket, as whole numbers in an array of doubles.

    Counting by the runs of the sorted buckets, of which each is there once
    more than in the text, keeps the work inside the row: no explode, no
    shuffle, and one pass whatever `dim` is.
    """
    buckets = F.transform(
        bare_words(F.lower(F.coalesce(text, F.lit("")))),
        lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim,
    )
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))

    def counts(held: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(held)), lambda i: (i == F.size(held)) | (F.get(held, i) != F.get(held, i - 1)))
        return let(last, lambda ends: F.transform(
            ends, lambda end, b: (end - F.coalesce(F.get(ends, b - 1), F.lit(0)) - 1).cast("double")))

    return let(F.sort_array(F.concat(buckets, numbers)), counts)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def l2_normalise(vector: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    wide = vector.cast("array<double>")
    length = norm(wide)
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)
