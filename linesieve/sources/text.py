"""Lines of text files, in file order, without a global sort or counter."""

from __future__ import annotations

import shutil
from collections.abc import Sequence
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import prefix_bytes
from ..functions.validate import valid_path
from ..runtime import shared_folder

STREAM_SCHEMA = "line string"


def _files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name, URI, length) of the files of a path, in name order, from the file system's listing alone."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    flat = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.isFile() and f.getPath().getName()[:1] not in "._"]
    return [(f.getPath().toString(), f.getPath().toUri().toString(), int(f.getLen())) for f in sorted(flat, key=lambda f: f.getPath().toString())]


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, max_input_bytes: int | None = None, validate: bool = True) -> DataFrame:
    """``src, ord, line, had_newline`` of all lines of the given files or folders, in the order given.

    Only a newline ends a line; carriage returns and NULs belong to it. ``ord`` runs from 1 over all files.
    A block is read by one task, whose row ids are consecutive: a number is the count of all blocks before
    plus the distance from the block's first id. Only the table of blocks is sorted, the lines aren't moved.
    ``had_newline`` is false for an unterminated last line, which the bytes of a file's lines tell against its
    length. Bytes that are no UTF-8 are read as U+FFFD. An empty file has no lines. Raises for paths that don't pass :func:`valid_path` and for files
    longer than ``max_input_bytes``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if validate and not valid_path(p.split("://", 1)[-1]):
            raise ValueError(f"not a valid path: {p!r}")
    files = [f for p in paths for f in _files(spark, p)]
    for name, _, size in files:
        if max_input_bytes is not None and size > max_input_bytes:
            raise ValueError(f"{name} is longer than {max_input_bytes} bytes")
    if not files:
        return spark.createDataFrame([], "src string, ord bigint, line string, had_newline boolean")
    files = list(dict.fromkeys(files))
    order = spark.createDataFrame([(u, k) for k, (_, u, _) in enumerate(files)], "_uri string, _file int")
    raw = spark.read.text([f[0] for f in files], lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"))
    norm = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    # One row per input file, which the driver has listed anyway: small beside the input.
    rows = raw.withColumn("_key", norm(F.col("src"))).join(order.withColumn("_key", norm(F.col("_uri"))).drop("_uri"), "_key")
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_from"), F.sum(F.octet_length("line") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = Window.partitionBy("_file")
    # A byte order mark, three bytes, is no part of any line.
    ends = F.sum("_bytes").over(total).isin(F.col("_size"), F.col("_size") - 3)
    placed = before.select("_file", "_block", "_from", "_before", F.max(F.col("_before") + F.col("_n")).over(total).alias("_last"), ends.alias("_ends"))
    numbered = rows.join(placed, ["_file", "_block"]).withColumn("ord", (F.col("_before") + F.col("_id") - F.col("_from") + 1).cast("bigint"))
    return numbered.select("src", "ord", "line", (F.col("_ends") | (F.col("ord") < F.col("_last"))).alias("had_newline"))


def kept_stream(spark: SparkSession, stream: BinaryIO) -> str:
    """Copies a byte stream, such as standard input, into the shared folder as one file and gives its path."""
    path = shared_folder(spark, "stdin") + ".txt"
    if path.startswith(("file:", "/")):
        local = "/" + path.split(":", 1)[-1].lstrip("/")
        with open(local, "wb") as out:
            shutil.copyfileobj(stream, out, 1 << 20)
        return path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    while piece := stream.read(1 << 22):
        out.write(piece)
    out.close()
    return path


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files that appear in a folder."""
    return spark.readStream.text(folder, lineSep="\n").withColumnRenamed("value", "line")


def column_lines(df: DataFrame, text: str, *order: str) -> DataFrame:
    """``line``, ``line_no`` (from 1) and the order columns of each line of a text column; a null text has no lines."""
    parts = df.select(*order, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "line"))
    return parts.select(*order, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def line_key(line: Column, had_newline: Column | None = None, max_line_bytes: int | None = None) -> Column:
    """The key of a line: its text, with the newline if strict, cut to a byte prefix if limited.

    A cut key is written in hex digits, since a cut may split a character; it has lost its newline.
    """
    key = line if had_newline is None else F.concat(line, F.when(had_newline, F.lit("\n")).otherwise(F.lit("")))
    if max_line_bytes is None:
        return key
    long = F.octet_length(key) > max_line_bytes
    return F.when(long, F.concat(F.lit("\x00hex:"), F.lower(F.hex(prefix_bytes(key, max_line_bytes))))).otherwise(key)
