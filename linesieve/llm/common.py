"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ensure_checkpoint_dir, shared_folder, written

__all__ = ["cut", "ensure_checkpoint_dir", "key128", "noted", "records", "shared_folder", "slots", "written"]

#: Second seed of the 128-bit key identity.
_SALT = 0x5EED


def key128(col: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: the identity of a key in shuffles and filters."""
    return F.xxhash64(col), F.xxhash64(F.lit(_SALT), col)


def noted(seen: Observation) -> dict:
    """What an observation has seen; nothing if the rows turned out to be none and it fell out of the plan with them."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


def slots(spark: SparkSession) -> int:
    """Tasks that a wide stage should have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def records(items: DataFrame, *value_cols: Column, src: str = "src", ord: str = "ord", item_id: str = "item_id") -> DataFrame:
    """One row per record (``src``, ``ord``) with the given value columns; second deliveries fall away.

    Deliveries of one record carry the same values, so any of them serves. A row whose ``src`` or
    ``ord`` is null can't be recognised as a second delivery and is a record of its own.
    Fixed-width value columns keep the aggregation in the hash aggregate with map-side combine.
    """
    lone = F.when(F.col(src).isNull() | F.col(ord).isNull(), F.col(item_id))
    keyed = items.select(F.col(src).alias("_src"), F.col(ord).alias("_ord"), lone.alias("_lone"), *value_cols)
    names = keyed.columns[3:]
    return keyed.groupBy("_src", "_ord", "_lone").agg(*(F.min(n).alias(n) for n in names)).select(*names)
