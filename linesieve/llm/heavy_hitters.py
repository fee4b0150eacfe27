"""Most frequent items in bounded memory: count-sketches over hash-bit prefixes.

Every key has a 64-bit hash. For each level (8, 16, ... 64 leading bits) a count-sketch with signed
hashes adds the key's weight under its prefix. Sketches are linear: each task fills its own with
whole-array operations, and the tables are summed. From the summed tables the heavy prefixes are
followed downwards, eight bits at a time, which recovers the hashes of all candidates without a
list of keys. A second scan sums the candidates' weights exactly.

Memory: levels x depth x width numbers a task and in the driver, whatever the input. At a level at
most (grand total / threshold) prefixes are heavy in truth; estimates within the slack add few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .peeling import _mix

LEVELS = tuple(range(8, 65, 8))
CELLS = "level int, row int, col int, value double"


@dataclass(frozen=True)
class SketchShape:
    """``width`` columns (a power of two) in each of ``depth`` rows; error of an estimate about sqrt(F2 / width)."""

    depth: int = 5
    width: int = 1 << 14

    @property
    def bytes(self) -> int:
        return len(LEVELS) * self.depth * self.width * 8


def _cells(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(prefix, 1009 * level + row + 1)
    return (h & np.uint64(width - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _fill(shape: SketchShape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for rb in batches:
            if not rb.num_rows:
                continue
            h = rb.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            w = rb.column(1).to_numpy(zero_copy_only=False).astype(float)
            h, at = np.unique(h, return_inverse=True)  # copies within a batch are added once
            w = np.bincount(at, w, len(h))
            if tables is None:
                tables = np.zeros((len(LEVELS), shape.depth, shape.width))
            for i, level in enumerate(LEVELS):
                prefix = h >> np.uint64(64 - level)
                if level < 64:
                    first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
                    prefix, pw = prefix[first], np.add.reduceat(w, first)
                else:
                    pw = w
                for row in range(shape.depth):
                    col, sign = _cells(prefix, level, row, shape.width)
                    tables[i, row] += np.bincount(col, sign * pw, shape.width)
        if tables is not None:
            i, row, col = np.nonzero(tables)
            for a in range(0, len(i), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(LEVELS, np.int32)[i[s]], row[s].astype(np.int32), col[s].astype(np.int32), tables[i[s], row[s], col[s]])], names=["level", "row", "col", "value"])

    return run


class HierarchicalSketch:
    """The summed tables, held by the driver (``shape.bytes`` in all)."""

    def __init__(self, shape: SketchShape, tables: np.ndarray):
        self.shape, self.tables = shape, tables

    @classmethod
    def of(cls, weighted: DataFrame, shape: SketchShape) -> HierarchicalSketch:
        """``weighted`` has two columns: a 64-bit hash and a weight; both without nulls."""
        cells = weighted.mapInArrow(_fill(shape), CELLS).groupBy("level", "row", "col").agg(F.sum("value").alias("value"))
        tables = np.zeros((len(LEVELS), shape.depth, shape.width))
        got = cells.toArrow()  # at most levels x depth x width rows, by construction
        level = got["level"].to_numpy() // 8 - 1
        tables[level, got["row"].to_numpy(), got["col"].to_numpy()] = got["value"].to_numpy()
        return cls(shape, tables)

    def estimate(self, prefix: np.ndarray, level: int) -> np.ndarray:
        """Median over the rows."""
        i = LEVELS.index(level)
        each = []
        for row in range(self.shape.depth):
            col, sign = _cells(prefix, level, row, self.shape.width)
            each.append(self.tables[i, row, col] * sign)
        return np.median(each, axis=0)

    def error(self, level: int) -> float:
        """Standard error of one row's estimate at a level, from the table itself (its squares sum to F2)."""
        i = LEVELS.index(level)
        return float(np.sqrt(np.median((self.tables[i] ** 2).sum(axis=1)) / self.shape.width))

    def heavy(self, threshold: float, slack: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes whose estimate reaches ``threshold`` less ``slack`` standard errors, with the estimates.

        A prefix weighs at least as much as each key below it, so no heavy key is lost on the way but
        by an estimate that misses by more than the slack in most rows.
        """
        prefix = np.zeros(1, np.uint64)
        found = np.zeros(0)
        for level in LEVELS:
            prefix = ((prefix[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None, :]).ravel()
            found = self.estimate(prefix, level)
            keep = found >= max(threshold - slack * self.error(level), threshold / 2)
            prefix, found = prefix[keep], found[keep]
            if not len(prefix):
                break
        return prefix, found


def heavy_hitters(weighted: DataFrame, key: str, weight: str, record_key: list[str], *, share: float, shape: SketchShape | None = None) -> DataFrame:
    """Keys holding at least ``share`` of the total weight: ``key``, ``total``, ``estimate``, ``grand_total``.

    ``weighted`` has one or more copies of each record (named by ``record_key``); copies count once. A
    null weight counts 1, null keys fall away, and a record whose name has a null stands for itself,
    which the caller provides for (see ``lone`` in queries). An empty input gives no rows.
    """
    spark, shape = weighted.sparkSession, shape or SketchShape()
    names = [f"_r{i}" for i in range(len(record_key))]
    columns = [F.col(c).alias(n) for c, n in zip(record_key, names)]
    rows = weighted.where(F.col(key).isNotNull()).select(*columns, F.col(key).alias("_key"), F.xxhash64(F.col(key)).alias("_h"), F.coalesce(F.col(weight), F.lit(1)).cast("long").alias("_w"))
    once = cut(rows.groupBy(*names).agg(F.min("_h").alias("_h"), F.min("_w").alias("_w")).select("_h", "_w"))
    grand = once.agg(F.sum("_w")).first()[0] or 0
    sketch = HierarchicalSketch.of(once, shape)
    hashes, estimates = sketch.heavy(grand * share) if grand > 0 else (np.zeros(0, np.uint64), np.zeros(0))
    # The candidates number at most about 2 / share, however large the input.
    found = spark.createDataFrame([(int(h), float(e)) for h, e in zip(hashes.view(np.int64), estimates)], "_h bigint, estimate double")
    again = rows.join(F.broadcast(found), "_h")
    each = again.groupBy(*names, "_key", "estimate").agg(F.min("_w").alias("_w"))
    total = each.groupBy("_key", "estimate").agg(F.sum("_w").alias("total"))
    return total.where(F.col("total") >= F.lit(grand * share)).select(F.col("_key").alias(key), "total", "estimate", F.lit(grand).cast("long").alias("grand_total"))
