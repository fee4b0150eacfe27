"""Options of a deduplication run, their validation, and the policies for capacity, error rate and method."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("unique", "duplicates", "groups", "once", "counts")
METHODS = ("exact", "bloom", "scaling", "partitioned", "auto")
FORMATS = ("text", "json", "csv", "tsv")
FAMILIES = ("xxhash64", "md5", "murmur3")

DEFAULT_ERROR = 0.01
STREAM_CAPACITY = 50_000_000
LEAST_CAPACITY, MOST_FILE_CAPACITY = 1000, 10_000_000


def file_capacity(n_bytes: int) -> int:
    """Expected number of lines of a file: half as many again as lines of 20 bytes, within fixed limits."""
    return max(LEAST_CAPACITY, min(MOST_FILE_CAPACITY, n_bytes // 20 * 3 // 2))


def file_capacity_column(n_bytes: Column) -> Column:
    """:func:`file_capacity` of a column of sizes."""
    lines = F.floor(F.floor(n_bytes / 20) * 3 / 2)
    return F.greatest(F.lit(LEAST_CAPACITY), F.least(F.lit(MOST_FILE_CAPACITY), lines)).cast("bigint")


def stream_error(error_rate: float) -> float:
    """An unbounded input is never filtered more strictly than the default."""
    return max(error_rate, DEFAULT_ERROR)


@dataclass(frozen=True)
class DedupOptions:
    """What to do with the lines of an input.

    ``capacity``: a number of keys, or ``auto`` for an estimate of the distinct keys. ``method``: ``auto``
    is exact. ``max_line_bytes`` cuts keys to a byte prefix; ``strict_newline`` makes a final line without
    newline another key; ``num_buckets`` is the number of independent filters of ``partitioned``.
    """

    mode: str = "unique"
    method: str = "exact"
    error_rate: float = DEFAULT_ERROR
    capacity: int | str = "auto"
    family: str = "xxhash64"
    num_buckets: int = 64
    max_line_bytes: int | None = None
    max_input_bytes: int | None = None
    strict_newline: bool = False
    limit: int | None = None
    fmt: str = "text"
    stats: bool = False
    save_model: str | None = None
    load_model: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, value, allowed in (("mode", self.mode, MODES), ("method", self.method, METHODS), ("fmt", self.fmt, FORMATS), ("family", self.family, FAMILIES)):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
        if not 0.0 < self.error_rate < 1.0:
            raise ValueError("error_rate must lie between 0 and 1")
        if self.capacity != "auto" and (not isinstance(self.capacity, int) or self.capacity < LEAST_CAPACITY):
            raise ValueError(f"capacity must be 'auto' or at least {LEAST_CAPACITY}")
        if self.num_buckets < 1:
            raise ValueError("num_buckets must be positive")
        for name in ("max_line_bytes", "max_input_bytes", "limit"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.method == "scaling" and self.mode != "unique":
            raise ValueError("a scaling filter only tells unique lines")
