"""Scaling filters: a list of sub-filters of constant capacity and shrinking error, grown as keys arrive.

Each sub-filter takes the first ``capacity`` - 1 lines it calls new; lines after them that it knows are
dropped, the rest go to the next one. Written as rounds: one aggregation per sub-filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HashFamily
from ..functions.sizing import ScalingParams, level_error, scaling_params
from ..runtime import cut
from .bloom import DEFAULT_FAMILY, with_halves
from .counting import _at, _positions
from .exact import first_occurrences


@dataclass(frozen=True)
class Level:
    """A sub-filter: its number from 0, parameters, order of its first line (null for the first) and lines held."""

    level: int
    params: ScalingParams
    start: int | None
    count: int


@dataclass
class ScalingResult:
    """Accepted lines (key, order, level), the positions of all levels (level, pos, min_order), and the levels."""

    accepted: DataFrame
    model: DataFrame
    levels: list[Level]


def nth_smallest(df: DataFrame, order: str, n: int) -> int | None:
    """The ``n``-th smallest value of an integer column, counted from 1; None if there are fewer values.

    Counts in equal ranges narrow the range down to one value, so that no task holds the first ``n`` rows.
    """
    low, high, rows = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if rows < n:
        return None
    below = 0
    while low < high:
        width = -(-(high - low + 1) // 4096)
        part = ((F.col(order) - F.lit(low)) / F.lit(width)).cast("bigint") if width == 1 else F.expr(f"(`{order}` - {low}L) div {width}L")
        counts = sorted(tuple(r) for r in df.where(F.col(order).between(low, high)).groupBy(part.alias("part")).count().collect())  # at most 4,096 rows
        for k, c in counts:
            if below + c >= n:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            below += c
    return int(low)


def scaling_unique(df: DataFrame, key: str, order: str, capacity: int, error: float, family: HashFamily = DEFAULT_FAMILY, first_level: int = 0, most_levels: int | None = None) -> ScalingResult:
    """Lines that a scaling filter calls new. ``order`` must be a unique integer.

    The errors of the levels add up to less than ``error``. There is a round for each sub-filter, over the
    lines up to where it is full: what a sub-filter takes doesn't depend on later lines. ``first_level`` is
    above 0 for a filter that goes on after saved sub-filters. With ``most_levels``, needing more raises.
    """
    left = cut(first_occurrences(df, key, order))
    accepted, models, levels = [], [], []
    start, level = None, first_level
    while True:
        if most_levels is not None and level >= most_levels:
            raise ValueError(f"more than {most_levels} sub-filters of capacity {capacity} are needed")
        params = scaling_params(capacity, level_error(error, level))
        ahead = capacity + capacity // 8
        while True:
            upto = nth_smallest(left, order, ahead)
            near = left if upto is None else left.where(F.col(order) <= upto)
            rows = near.select(F.col(order), F.explode(_positions(family, F.col(key), params)).alias("pos"))
            owners = cut(rows.groupBy("pos").agg(F.min(order).alias("min_order")))
            new = cut(near.join(owners.select(F.col("min_order").alias("_own")).distinct(), near[order] == F.col("_own"), "left_semi"))
            last = nth_smallest(new, order, capacity - 1)
            if last is not None or upto is None:
                break
            ahead *= 2
        full = last is not None and bool(left.where(F.col(order) > last).take(1))
        frozen = owners.where(F.col("min_order") <= last) if full else owners
        taken = new.where(F.col(order) <= last) if full else new
        accepted.append(taken.withColumn("level", F.lit(level)))
        models.append(frozen.withColumn("level", F.lit(level)))
        levels.append(Level(level, params, start, capacity - 1 if last is not None else new.count()))
        if not full:
            break
        later = left.where(F.col(order) > last)
        keyed = with_halves(later, key, family)
        ask = keyed.select(F.col(order), F.explode(_at(family, F.col("_a"), F.col("_b"), params)).alias("pos"))
        known = ask.join(frozen.select("pos", F.lit(1).alias("_set")), "pos", "left").groupBy(order).agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all")).where("_all = 1").select(F.col(order).alias("_seen"))
        rest = cut(later.join(known, later[order] == F.col("_seen"), "left_anti"))
        if not rest.take(1):
            break
        left, start, level = rest, int(last) + 1, level + 1
    out, model = accepted[0], models[0]
    for a, m in zip(accepted[1:], models[1:]):
        out, model = out.unionByName(a), model.unionByName(m)
    return ScalingResult(out, model, levels)


def scaling_hits(probe: DataFrame, key: str, model: DataFrame, levels: list[Level], family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """The halves (``_a``, ``_b``) of the keys of ``probe`` that any sub-filter knows."""
    keys = with_halves(probe, key, family).select("_a", "_b").distinct()
    out = None
    for lv in levels:
        rows = keys.select("_a", "_b", F.explode(_at(family, F.col("_a"), F.col("_b"), lv.params)).alias("pos"))
        bits = model.where(F.col("level") == lv.level).select("pos", F.lit(1).alias("_set"))
        hit = rows.join(bits, "pos", "left").groupBy("_a", "_b").agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all")).where("_all = 1").select("_a", "_b")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def scaling_anti(probe: DataFrame, key: str, model: DataFrame, levels: list[Level], family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Rows of ``probe`` whose key no sub-filter knows."""
    known = scaling_hits(probe, key, model, levels, family)
    return with_halves(probe, key, family).join(known, ["_a", "_b"], "left_anti").select(*probe.columns)


def owning_level(levels: list[Level], order: int) -> int:
    """The sub-filter that a line of this order was added to: the last one that started at or before it."""
    return max(lv.level for lv in levels if lv.start is None or lv.start <= order)


def scaling_counters(accepted: DataFrame, key: str, levels: list[Level], family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Counters (level, pos, n) of the accepted lines."""
    out = None
    for lv in levels:
        rows = accepted.where(F.col("level") == lv.level).select(F.explode(_positions(family, F.col(key), lv.params)).alias("pos"))
        part = rows.groupBy("pos").agg(F.count("*").alias("n")).withColumn("level", F.lit(lv.level))
        out = part if out is None else out.unionByName(part)
    return out


def scaling_remove(counts: DataFrame, gone: DataFrame, key: str, order: str, levels: list[Level], family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Counters after the lines of ``gone`` (key, order) are removed from the sub-filters that own their orders."""
    level = F.lit(0)
    for lv in levels[1:]:
        level = F.when(F.col(order) >= lv.start, lv.level).otherwise(level)
    owned = gone.withColumn("level", level)
    minus = scaling_counters(owned, key, levels, family).withColumn("n", -F.col("n"))
    return counts.unionByName(minus).groupBy("level", "pos").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")
