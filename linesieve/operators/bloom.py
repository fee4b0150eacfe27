"""Fixed Bloom filters as relations.

A sequential pass that emits a line when one of its positions is still unset emits exactly the lines that
hold, at some position, the smallest order of all lines touching it. So the filter is an aggregation:
explode the positions of distinct lines, take the minimum order of each, keep the lines that own one.
The result, false positives included, doesn't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HashFamily, Md5, XxHash
from ..functions.sizing import BloomParams
from .exact import first_occurrences

DEFAULT_FAMILY = XxHash()


def positions(df: DataFrame, key: str, order: str, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """One row (order, pos) per position of each distinct key, under its first order."""
    firsts = first_occurrences(df, key, order)
    return firsts.select(F.col(order), F.explode(F.array_distinct(family.positions(F.col(key), params.hashes, params.bits))).alias("pos"))


def build(df: DataFrame, key: str, order: str, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """The filter: each set position with the smallest order that touches it."""
    return positions(df, key, order, params, family).groupBy("pos").agg(F.min(order).alias("min_order"))


def unique(df: DataFrame, key: str, order: str, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Lines that the filter calls new, with their order: distinct lines less the false positives."""
    owners = build(df, key, order, params, family).select(F.col("min_order").alias("_own")).distinct()
    firsts = first_occurrences(df, key, order)
    return firsts.join(owners, firsts[order] == F.col("_own"), "left_semi")


def partitioned_unique(df: DataFrame, key: str, order: str, params: BloomParams, buckets: int, family: HashFamily = DEFAULT_FAMILY, bucket: Column | None = None) -> DataFrame:
    """Like :func:`unique` with ``buckets`` independent filters of ``params`` each; a key belongs to one of them."""
    firsts = first_occurrences(df, key, order)
    which = family.bucket(F.col(key), buckets) if bucket is None else bucket
    rows = firsts.select(F.col(order), which.alias("bucket"), F.explode(F.array_distinct(family.positions(F.col(key), params.hashes, params.bits))).alias("pos"))
    owners = rows.groupBy("bucket", "pos").agg(F.min(order).alias("_own")).select("_own").distinct()
    return firsts.join(owners, firsts[order] == F.col("_own"), "left_semi")


def with_halves(df: DataFrame, key: str, family: HashFamily) -> DataFrame:
    """``df`` with the two halves of its key as ``_a`` and ``_b``."""
    a, b = family.halves(F.col(key))
    return df.withColumn("_a", a).withColumn("_b", b)


def hits(probe: DataFrame, key: str, model: DataFrame, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """The halves (``_a``, ``_b``) of the keys of ``probe`` whose positions are all set in ``model`` (a relation with ``pos``).

    The texts of the keys stay where they are: 16 bytes a key are spread over its positions.
    """
    keys = with_halves(probe, key, family).select("_a", "_b").distinct()
    rows = keys.select("_a", "_b", F.explode(F.array_distinct(family.at(F.col("_a"), F.col("_b"), params.hashes, params.bits))).alias("pos"))
    need = rows.join(model.select("pos", F.lit(1).alias("_set")), "pos", "left")
    return need.groupBy("_a", "_b").agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all")).where("_all = 1").select("_a", "_b")


def _by_hits(probe: DataFrame, key: str, model: DataFrame, params: BloomParams, family: HashFamily, how: str) -> DataFrame:
    known = hits(probe, key, model, params, family)
    return with_halves(probe, key, family).join(known, ["_a", "_b"], how).select(*probe.columns)


def semi(probe: DataFrame, key: str, model: DataFrame, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Rows of ``probe`` whose key the filter knows; no key that was added is missed."""
    return _by_hits(probe, key, model, params, family, "left_semi")


def anti(probe: DataFrame, key: str, model: DataFrame, params: BloomParams, family: HashFamily = DEFAULT_FAMILY) -> DataFrame:
    """Rows of ``probe`` whose key the filter doesn't know; none of them was added."""
    return _by_hits(probe, key, model, params, family, "left_anti")


def merged(*models: DataFrame) -> DataFrame:
    """Union of filters of equal parameters: a position is set if any of them sets it."""
    out = models[0].select("pos", "min_order")
    for m in models[1:]:
        out = out.unionByName(m.select("pos", "min_order"))
    return out.groupBy("pos").agg(F.min("min_order").alias("min_order"))


def info(spark, params: list[BloomParams]) -> DataFrame:
    """Sizes of filters, one row each."""
    return spark.createDataFrame([(p.entries, p.error, p.bits, p.bpe, p.bytes, p.hashes) for p in params], "entries bigint, error double, bits bigint, bpe double, bytes bigint, hashes int")


def measured_error(df: DataFrame, key: str, order: str, params: BloomParams, family: HashFamily = Md5()) -> DataFrame:
    """Distinct lines, lines the filter emitted, and those it lost."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    exact = first_occurrences(df, key, order).select(one.alias("d"), none.alias("e"))
    emitted = unique(df, key, order, params, family).select(none.alias("d"), one.alias("e"))
    both = exact.unionByName(emitted).agg(F.coalesce(F.sum("d"), none).alias("distinct_lines"), F.coalesce(F.sum("e"), none).alias("emitted_lines"))
    return both.withColumn("lost_lines", F.col("distinct_lines") - F.col("emitted_lines"))
