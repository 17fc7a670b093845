"""What chunk sizes and memory windows may count instead of words.

A unit turns a text into an array of pieces. Joined, they give back the text
from its first character that is not white space on, so the place of a piece
is the length of those before it. Memory windows take `cost=units_in(unit, text)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from docflow.functions.text import WORD_SPACE

Unit = Callable[[Column], Column]


def pattern_unit(pattern: str) -> Unit:
    """Matches of a pattern, each with the white space behind it; a character that it does not match is a piece of its own.

    The pattern is Java's and matches no white space. It stays in the JVM.
    """
    return lambda text: F.regexp_extract_all(F.ltrim(text, F.lit(WORD_SPACE)), F.lit(rf"((?:{pattern}|\S)\s*)"), F.lit(1))


def tokenizer_unit(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Unit:
    """Tokens of any tokenizer: `load()` runs once per task and returns a function from texts to the first character of each token.

    A token that begins inside a character, as byte-level ones may, begins with
    it: of several at one character the first has the text and the others are
    empty, so the number of pieces is that of the tokens.
    """
    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        starts_of = load()
        for series in texts:
            bare = [t.lstrip(WORD_SPACE) if t is not None else "" for t in series]
            out = []
            for text, starts in zip(bare, starts_of(bare)):
                # What lies before the first token belongs to it.
                places = [0, *starts[1:], len(text)] if starts else []
                out.append([text[a:b] for a, b in zip(places, places[1:])])
            yield pd.Series(out, dtype="object")

    return lambda text: pieces(text)


def units_in(unit: Unit, text: Column) -> Column:
    """How many units a text has; 0 for null."""
    return F.coalesce(F.size(unit(text)), F.lit(0))


