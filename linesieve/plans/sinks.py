"""Writing results as text, TSV, CSV or JSON, ordered by ``ord`` across the part files or on a stream.

Where a result has counts (``cnt``), every format has them: before the line and a blank in text, as a
second column in TSV and CSV, as a second field in JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import csv_quoted, json_line
from ..options import FORMATS


def rendered(df: DataFrame, fmt: str) -> DataFrame:
    """One text row (``value``) per line; JSON as one object a line. A null line is an empty text row (JSON: no field ``line``)."""
    line, n = F.coalesce(F.col("line"), F.lit("")), F.col("cnt").cast("string") if "cnt" in df.columns else None
    if fmt == "json":
        value = json_line(F.col("line"), None if n is None else F.col("cnt"))
    elif n is None:
        value = csv_quoted(line) if fmt == "csv" else line
    else:
        value = {"text": F.concat(n, F.lit(" "), line), "tsv": F.concat(line, F.lit("\t"), n), "csv": F.concat(csv_quoted(line), F.lit(","), n)}[fmt]
    return df.select("ord", value.alias("value"))


def write(df: DataFrame, path: str, fmt: str = "text", ordered: bool = True, mode: str = "errorifexists") -> None:
    """Part files below ``path``; their names keep the order. CSV parts have a header each."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "csv":
        out = df.orderBy("ord") if ordered else df
        columns = [c for c in ("line", "cnt") if c in df.columns]
        out.select(*columns).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return
    out = rendered(df, fmt)
    (out.orderBy("ord") if ordered else out).select("value").write.mode(mode).text(path, lineSep="\n")


def texts(df: DataFrame, fmt: str) -> Iterator[str]:
    """The rendered lines in order, fetched partition by partition, all of them."""
    if fmt == "csv":
        yield "line,cnt" if "cnt" in df.columns else "line"
    for r in rendered(df, fmt).orderBy("ord").select("value").toLocalIterator():
        yield r["value"]


def json_document(df: DataFrame, statistics: dict) -> Iterator[str]:
    """Pieces of one JSON document with all lines and the statistics, of any length."""
    yield '{"format": "linesieve", "version": "1.0", "lines": ['
    comma = ""
    for line in texts(df, "json"):
        yield comma + line
        comma = ","
    yield f'], "statistics": {json.dumps(statistics, ensure_ascii=False)}}}'
