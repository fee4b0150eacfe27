"""Counting filters: frequency estimates, prior counts and removal, with counters that saturate at 15.

A counter is the number of rows that touch a position. Lines are counted first, so that copies of a line
travel as one row with its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HashFamily
from ..functions.sizing import BloomParams, ScalingParams
from .bloom import DEFAULT_FAMILY, with_halves

SATURATION = 15


def _at(family: HashFamily, a: Column, b: Column, params: BloomParams | ScalingParams) -> Column:
    """Positions from the halves of a key; a sliced filter has one slice of counters per hash function."""
    if isinstance(params, ScalingParams):
        return family.at(a, b, params.hashes, params.per_hash, sliced=True)
    return F.array_distinct(family.at(a, b, params.hashes, params.bits))


def _positions(family: HashFamily, key: Column, params: BloomParams | ScalingParams) -> Column:
    return _at(family, *family.halves(key), params)


def counters(df: DataFrame, key: str, params: BloomParams | ScalingParams, family: HashFamily = DEFAULT_FAMILY, sign: int = 1) -> DataFrame:
    """``pos`` and ``n``, the rows that touch it; ``sign`` -1 gives a relation of removals."""
    lines = df.groupBy(key).agg(F.count("*").alias("_c"))
    rows = lines.select("_c", F.explode(_positions(family, F.col(key), params)).alias("pos"))
    return rows.groupBy("pos").agg((F.sum("_c") * sign).cast("bigint").alias("n"))


def merged(*models: DataFrame) -> DataFrame:
    """Sum of counter relations: additions and removals in any order. Positions without rows fall away."""
    out = models[0].select("pos", "n")
    for m in models[1:]:
        out = out.unionByName(m.select("pos", "n"))
    return out.groupBy("pos").agg(F.sum("n").cast("bigint").alias("n")).where("n <> 0")


def estimates(probe: DataFrame, key: str, model: DataFrame, params: BloomParams | ScalingParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Each distinct key with ``estimate``: the smallest of its counters, 0 to 15, never below min(count, 15).

    The halves of the keys visit the counters; the keys themselves are fetched at the end.
    """
    keys = with_halves(probe.select(F.col(key)).distinct(), key, family)
    rows = keys.select("_a", "_b", F.explode(_at(family, F.col("_a"), F.col("_b"), params)).alias("pos"))
    got = rows.join(model, "pos", "left")
    n = F.least(F.min(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))), F.lit(SATURATION))
    return keys.join(got.groupBy("_a", "_b").agg(n.cast("int").alias("estimate")), ["_a", "_b"]).select(key, "estimate")


def faults(model: DataFrame) -> DataFrame:
    """One row: counters that 4 bits can't hold (``overflows``) and counters taken below zero (``underflows``)."""
    return model.agg(F.count_if(F.col("n") > SATURATION).alias("overflows"), F.count_if(F.col("n") < 0).alias("underflows"))


def contains(probe: DataFrame, key: str, model: DataFrame, params: BloomParams | ScalingParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Distinct keys all of whose counters are above zero."""
    return estimates(probe, key, model, params, family).where("estimate > 0").select(key)


def prior_counts(df: DataFrame, key: str, order: str, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """For each row, ``prior``: the smallest counter of its key before the row, up to 15; 0 means new.

    Only the first 16 rows of a key and of a position can matter: later ones have a count of 15. The rank
    filters are pushed below the shuffle, so a hot key or position sends at most 16 rows a task. Keys are
    ranked by their halves; their texts aren't moved for it.
    """
    most = SATURATION + 1
    keyed = with_halves(df.select(key, order), key, family)
    rank = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(order))
    early = keyed.select("_a", "_b", order).withColumn("_r", rank).where(F.col("_r") <= most)
    rows = early.select(F.col(order), F.explode(_at(family, F.col("_a"), F.col("_b"), params)).alias("pos"))
    at = F.row_number().over(Window.partitionBy("pos").orderBy(order))
    # A row beyond the first 16 of a position finds 15 there, so it is left out and counts as saturated.
    low = rows.withColumn("_n", at).where(F.col("_n") <= most).groupBy(order).agg((F.min("_n") - 1).alias("_least"))
    got = df.select(key, order).join(low.withColumnRenamed(order, "_order"), F.col(order) == F.col("_order"), "left")
    prior = F.least(F.coalesce("_least", F.lit(SATURATION)), F.lit(SATURATION)).cast("int")
    return got.select(key, order, prior.alias("prior"))


def insertion_statistics(priors: DataFrame) -> DataFrame:
    """Rows added, and those that were new to the filter."""
    return priors.agg(F.count("*").alias("total_insertions"), F.count_if(F.col("prior") == 0).alias("unique_insertions"))
