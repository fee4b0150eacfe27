"""Statistics of a run, as rows and as an observation taken on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def throughput(total: Column, seconds: Column) -> Column:
    """Lines per second; 0 where no time passed."""
    return F.when(seconds > 0, total / seconds).otherwise(0.0)


def line_statistics(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Total, unique and duplicate lines, over all rows or per group of ``by`` columns.

    Counted from lines with their copies, so that no group is gathered in one task. Empty inputs give zeros
    (one row) without ``by`` and no rows with it.
    """
    by = by or []
    lines = df.groupBy(*by, key).agg(F.count("*").alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    total, unique = zero(F.sum("_c")), F.count("*")
    return lines.groupBy(*by).agg(total.alias("total_lines"), unique.alias("unique_lines"), (total - unique).alias("duplicate_lines"))


def finished(stats: DataFrame, seconds: float, error_rate: float, memory_used: int = 0) -> DataFrame:
    """Adds time, memory, throughput and the configured error rate (0 without lines)."""
    t = F.lit(float(seconds))
    return stats.withColumns({
        "processing_time": t,
        "memory_used": F.lit(memory_used).cast("bigint"),
        "throughput": throughput(F.col("total_lines"), t),
        "false_positive_rate": F.when(F.col("total_lines") > 0, F.lit(error_rate)).otherwise(0.0),
    })


def observed(df: DataFrame, is_unique: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that holds the counters once an action has run over it."""
    seen = Observation("lines")
    zero = F.lit(0)
    return df.observe(seen, F.count("*").alias("total_lines"), F.coalesce(F.count_if(is_unique), zero).alias("unique_lines"), F.coalesce(F.count_if(~is_unique), zero).alias("duplicate_lines")), seen


def progress(current: int, total: int, elapsed: float) -> tuple[float, float]:
    """Percent done and seconds left; nothing done yet leaves an unknown time (infinity), no work is done."""
    if total <= 0:
        return 100.0, 0.0
    return 100.0 * current / total, (elapsed * total / current - elapsed) if current > 0 else float("inf")
