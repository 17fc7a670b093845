"""Include/exclude rules as one boolean column."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rule presets per kind of source. The last group of the url
# pattern needs no repeat: a search finds the same texts, and the matcher would
# recurse once per character of a long url.
PRESETS = {
    "repository": [r"(^|/)tests?/", r"__pycache__", r"\.md$", r"\.png$", r"\.jpg$", r"\.jpeg$"],
    "drive": [r"\.git/", r"\.DS_Store$", r"\.log$", r"/temp/", r"\.zip$", r"\.exe$", r"\.jpg$|\.png$|\.gif$"],
    "issues": [r"^TEST-", r"-BUG$", r"^EPIC-"],
    "posts": [
        r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))",
        r"RT @", r"@[A-Za-z0-9_]+", r"#[A-Za-z0-9_]+",
    ],
    "vault": [r"(^|/)\.obsidian/", r"(^|/)\.trash/", r"(^|/)\.git/", r"(^|/)temp/", r"\/_",
              r"\.(png|jpg|jpeg|pdf|drawio)$"],
    "key_value": [r"^cache:", r"^session:", r"^temp_", r"\.bin$", r"^system:", r"^lock:", r"^queue:"],
}

# What a vault scan leaves out whatever the caller asks for.
VAULT_DEFAULTS = [r"(^|/)\.obsidian/", r"(^|/)\.trash/", r"\.DS_Store$", r"\.git/", r"Thumbs\.db$"]
VAULT_INCLUDE = [r"\.md$"]

# File extensions the folder reader can turn into text.
SUPPORTED_EXTENSIONS = ["pdf", "docx", "pptx", "html", "txt"]


def valid_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile here and in the engine that runs them; each other one is reported and left out.

    A bad pattern would otherwise fail every task at run time, so it has to go
    while the plan is built.
    """
    engine = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern
    kept = []
    for pattern in patterns:
        try:
            re.compile(pattern)
            engine.compile(java_pattern(pattern))
        except (re.error, PySparkException):
            warnings.warn(f"invalid pattern skipped: {pattern}", stacklevel=2)
        else:
            kept.append(pattern)
    return kept


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def java_pattern(pattern: str) -> str:
    """A pattern for `rlike`: Unicode classes, Java's spelling of named groups and of the end of the text."""
    spelling = {"(?P<": "(?<", "\\Z": "\\z"}
    return "(?U)" + re.sub(
        r"\\.|\(\?P<(?=[A-Za-z])|\(\?P=(\w+)\)",
        lambda m: rf"\k<{m.group(1)}>" if m.group(1) else spelling.get(m.group(), m.group()), pattern, flags=re.S)


def matches_any(key: Column, patterns: list[str]) -> Column:
    return _any([key.rlike(java_pattern(p)) for p in patterns]) if patterns else F.lit(False)


def rule_condition(key: Column, include: list[str] | None = (), exclude: list[str] | None = ()) -> Column:
    """Keep when no exclusion is found and, given inclusions, at least one is.

    A missing key is the empty string. An include list without one valid
    pattern counts as no include list.
    """
    key = F.coalesce(key, F.lit(""))
    included = valid_patterns(include or [])
    keep = ~matches_any(key, valid_patterns(exclude or []))
    return keep & matches_any(key, included) if included else keep


def apply_rules(df: DataFrame, key: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    return df.filter(rule_condition(F.col(key), include, exclude))


def apply_vault_rules(df: DataFrame, include: list[str] = (), exclude: list[str] = (),
                      path: str = "file_path", extension: str = "file_extension") -> DataFrame:
    return df.filter(F.col(extension) == "md").filter(
        rule_condition(F.col(path), include, VAULT_DEFAULTS + list(exclude or ())))


def apply_supported_rules(df: DataFrame, include: list[str] = (), exclude: list[str] = (),
                          supported: list[str] = SUPPORTED_EXTENSIONS,
                          path: str = "file_path", extension: str = "file_extension") -> DataFrame:
    return df.filter(F.lower(extension).isin(*supported)).filter(
        rule_condition(F.col(path), include, exclude))


def apply_substring_rules(df: DataFrame, include: list[str] = (), exclude: list[str] = (),
                          path: str = "file_path", name: str = "file_name") -> DataFrame:
    """Case-insensitive containment in path or name; no pattern syntax."""
    keys = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (path, name)]

    def contains(parts):
        return _any([key.contains(part.lower()) for part in parts for key in keys])

    if exclude:
        df = df.filter(~contains(exclude))
    return df.filter(contains(include)) if include else df
