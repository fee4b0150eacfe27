"""Exact deduplication: first occurrences, repeats, counts.

Every operator takes any DataFrame, the key columns and one order column (or a struct) that is unique and
gives the order of arrival. Null keys are one ordinary key. All of them begin with an aggregation by key
that combines on the map side, so a key that fills a third of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def first_occurrences(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Each distinct key once, with the order of its first occurrence. An empty input gives no rows."""
    return df.groupBy(*_keys(key)).agg(F.min(order).alias(order))


def unique_rows(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The whole rows of first occurrences, all columns kept. ``order`` must be unique."""
    firsts = first_occurrences(df, key, order).select(F.col(order).alias("_first"))
    return df.join(firsts, df[order].eqNullSafe(F.col("_first")), "left_semi")


def repeats(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The whole rows of every occurrence but the first. The join is on the unique order, which no key can skew."""
    firsts = first_occurrences(df, key, order).select(F.col(order).alias("_first"))
    return df.join(firsts, df[order].eqNullSafe(F.col("_first")), "left_anti")


def counts(df: DataFrame, key: str | Sequence[str], order: str, weight: str | None = None) -> DataFrame:
    """Each key with ``cnt`` (or the sum of ``weight``, a null weight counting 1) and its first order."""
    n = F.count("*") if weight is None else F.sum(F.coalesce(F.col(weight), F.lit(1)))
    return df.groupBy(*_keys(key)).agg(n.cast("bigint").alias("cnt"), F.min(order).alias(order))


def repeated_keys(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Keys that occur more than once, one row each."""
    return counts(df, key, order).where("cnt > 1")


def single_keys(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Keys that occur exactly once."""
    return counts(df, key, order).where("cnt = 1")


def top_repeated(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` keys that occur most often, ties in key order."""
    return counts(df, key, order).orderBy(F.desc("cnt"), F.asc_nulls_first(key)).limit(n)


def new_rows(df: DataFrame, known: DataFrame, key: str, order: str, known_key: str | None = None) -> DataFrame:
    """First occurrences whose key isn't among the known ones; a null key is known if a null is."""
    firsts = first_occurrences(df, key, order)
    seen = known.select(F.col(known_key or key).alias("_known")).distinct()
    return firsts.join(seen, firsts[key].eqNullSafe(F.col("_known")), "left_anti")
