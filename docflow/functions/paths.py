"""Path, extension and modification-time columns."""

from pyspark.sql import Column, functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_type(name: Column) -> Column:
    """Lowercase text after the last dot; the whole name when it has no dot."""
    return F.lower(F.substring_index(name, ".", -1))


def file_extension(name: Column) -> Column:
    """Like `file_type`, but empty for a name without a dot."""
    return F.when(F.instr(name, ".") > 0, file_type(name)).otherwise("")


def splitext(name: Column) -> Column:
    """Extension by the operating system's rule: a leading dot starts no extension."""
    return F.lower(F.regexp_extract(name, r"(?s)[^.].*\.([^.]*)\z", 1))


def modified_at(value: Column, form: str) -> Column:
    """One timestamp type for the `epoch`, `iso` and `timestamp` forms sources deliver."""
    if form == "epoch":
        return F.timestamp_seconds(value)
    if form == "iso":
        return F.try_to_timestamp(F.nullif(value, F.lit("")))
    if form == "timestamp":
        return value.cast("timestamp")
    raise ValueError(f"unknown time form: {form}")
