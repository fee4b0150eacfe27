"""Checks of path and file names, as predicates and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PATH, MOST_NAME = 4096, 255
#: Characters and device names that a file name may not have.
BAD_IN_NAME = '/\\:*?"<>|'
DEVICES = ("CON", "PRN", "AUX", "NUL")
_CLIMBS = ("../", "/..", "//")


def valid_path(path: str | None) -> bool:
    """Not empty, shorter than 4,096 bytes, printable ASCII, without ``..`` steps and doubled slashes."""
    if not path or len(path.encode("utf-8", "surrogatepass")) >= MOST_PATH or path == "..":
        return False
    return all(" " <= c <= "~" for c in path) and not any(x in path for x in _CLIMBS)


def valid_filename(name: str | None) -> bool:
    """Not empty, shorter than 255 bytes, without separators and wildcards, leading dot or device name."""
    if not name or len(name.encode("utf-8", "surrogatepass")) >= MOST_NAME or name[0] == ".":
        return False
    return not any(c in BAD_IN_NAME for c in name) and name.upper() not in DEVICES


def valid_path_column(path: Column) -> Column:
    """:func:`valid_path` as a column; null is invalid."""
    ok = (F.octet_length(path) > 0) & (F.octet_length(path) < MOST_PATH) & (path != "..") & path.rlike(r"^[\x20-\x7E]*\z")
    for x in _CLIMBS:
        ok = ok & ~path.contains(x)
    return F.coalesce(ok, F.lit(False))


def valid_filename_column(name: Column) -> Column:
    """:func:`valid_filename` as a column; null is invalid."""
    ok = (F.octet_length(name) > 0) & (F.octet_length(name) < MOST_NAME) & ~name.startswith(".") & ~F.upper(name).isin(*DEVICES)
    for c in BAD_IN_NAME:
        ok = ok & ~name.contains(c)
    return F.coalesce(ok, F.lit(False))
