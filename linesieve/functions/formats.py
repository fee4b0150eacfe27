"""Lines as text, TSV, CSV and JSON: escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_escaped(line: Column) -> Column:
    """Escapes of backslash, quote, newline, carriage return and tab only; the JSON writer escapes all control characters."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        line = F.replace(line, F.lit(raw), F.lit(escaped))
    return line


def csv_quoted(line: Column) -> Column:
    """Always quoted, quotes doubled, newlines as blanks."""
    doubled = F.replace(F.replace(line, F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), doubled, F.lit('"'))


def json_line(line: Column, count: Column | None = None) -> Column:
    """A line, and its count if there is one, as a JSON object, all control characters escaped."""
    return F.to_json(F.struct(line.alias("line"), *([] if count is None else [count.alias("cnt")])))


def prefix_bytes(line: Column, most: int) -> Column:
    """The first ``most`` bytes of a line, as binary: a cut may fall inside a character."""
    return F.substring(F.encode(line, "UTF-8"), 1, most)
