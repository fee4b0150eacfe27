"""Command line: ``python -m linesieve.cli [options] [PATH...] [--out FOLDER]``; without a path, or with ``-``, standard input is read."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from . import __version__
from .options import DEFAULT_ERROR, FAMILIES, FORMATS, METHODS, MODES, DedupOptions

log = logging.getLogger("linesieve")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linesieve", description="Remove, find or count duplicate lines.")
    p.add_argument("paths", nargs="*", default=["-"], help="text files or folders; - is standard input, as is no path at all")
    p.add_argument("--out", help="folder for the result; without it, it goes to standard output, line by line")
    p.add_argument("-v", "--version", action="version", version=f"linesieve {__version__}")
    p.add_argument("-d", "--debug", type=int, default=0, metavar="N", help="0 to 9")
    p.add_argument("-e", "--error", type=float, default=DEFAULT_ERROR, help="error rate of filters")
    p.add_argument("-j", "--buckets", type=int, default=64, help="independent filters of the partitioned method")
    p.add_argument("-c", "--count", action="store_true", help="count occurrences")
    p.add_argument("-s", "--stats", action="store_true", help="show statistics")
    p.add_argument("-p", "--progress", action="store_true", help="show Spark's progress bar")
    p.add_argument("-D", "--duplicates", action="store_true", help="show repeated occurrences instead of unique lines")
    p.add_argument("-f", "--format", choices=FORMATS, default="text")
    p.add_argument("-b", "--bloom-type", choices=("regular", "scaling"), help="use a filter of this type")
    p.add_argument("-S", "--save-bloom", metavar="FOLDER")
    p.add_argument("-L", "--load-bloom", metavar="FOLDER", help="show only lines that this filter doesn't know")
    p.add_argument("-a", "--adaptive", action="store_true", help="size filters from an estimate of the distinct lines")
    p.add_argument("--mode", choices=MODES)
    p.add_argument("--method", choices=METHODS)
    p.add_argument("--family", choices=FAMILIES, default="xxhash64")
    p.add_argument("--capacity", type=int)
    p.add_argument("--max-line-bytes", type=int)
    p.add_argument("--strict-newline", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> DedupOptions:
    mode = a.mode or ("counts" if a.count else "duplicates" if a.duplicates else "unique")
    method = a.method or {"regular": "bloom", "scaling": "scaling"}.get(a.bloom_type, "exact")
    return DedupOptions(mode=mode, method=method, error_rate=a.error, capacity="auto" if a.adaptive or a.capacity is None else a.capacity, family=a.family, num_buckets=a.buckets, max_line_bytes=a.max_line_bytes, strict_newline=a.strict_newline, fmt=a.format, stats=a.stats, save_model=a.save_bloom, load_model=a.load_bloom)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .operators import stats
    from .plans import pipeline, sinks
    from .sources.text import kept_stream, read_lines

    a = parser().parse_args(argv)
    try:
        o = options_of(a)
    except ValueError as e:
        print(f"linesieve: {e}", file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.DEBUG if a.debug > 1 else logging.INFO if a.debug else logging.WARNING)
    spark = SparkSession.builder.appName("linesieve").config("spark.ui.showConsoleProgress", str(a.progress).lower()).getOrCreate()
    began = time.perf_counter()
    paths = [kept_stream(spark, sys.stdin.buffer) if p == "-" else p for p in a.paths]
    lines = read_lines(spark, paths, max_input_bytes=o.max_input_bytes)
    out = pipeline.run(lines, o)

    def statistics() -> str:
        return stats.finished(stats.line_statistics(lines, "line"), time.perf_counter() - began, o.error_rate).toJSON().first()

    if a.out:
        sinks.write(out, a.out, o.fmt)
    else:
        document = o.stats and o.fmt == "json"
        for piece in sinks.json_document(out, json.loads(statistics())) if document else sinks.texts(out, o.fmt):
            sys.stdout.write(piece + "\n")
        sys.stdout.flush()
    if o.stats and (a.out or o.fmt != "json"):
        print(statistics(), file=sys.stderr)
    log.info("done in %.1f s", time.perf_counter() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
