"""Saved filters: a table of positions and one row of parameters, loaded only with equal parameters.

Writing follows a two-number protocol: the number on disk is 0 while positions are being written and
equals the one in memory only after everything is there, so a reader recognises an unfinished model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import family as family_of
from ..functions.sizing import BloomParams, ScalingParams, bloom_params
from ..runtime import exists
from . import bloom
from .exact import first_occurrences
from .scaling import Level, ScalingResult, scaling_anti, scaling_unique

META = "kind string, capacity bigint, error_rate double, bits bigint, hashes int, family string, max_id bigint, mem_seqnum bigint, disk_seqnum bigint"


@dataclass(frozen=True)
class Model:
    """A loaded filter."""

    positions: DataFrame
    params: BloomParams
    family: str
    max_id: int
    seqnum: int


def _write_meta(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def save(positions: DataFrame, path: str, params: BloomParams, family: str = "xxhash64", max_id: int = 0, seqnum: int = 1) -> None:
    """Write a filter (``pos``, ``min_order``) under ``path``; an earlier one of a lower number is replaced."""
    spark = positions.sparkSession
    row = ("fixed", params.entries, params.error, params.bits, params.hashes, family, max_id, seqnum)
    _write_meta(spark, path, (*row, 0))
    positions.select("pos", "min_order").write.mode("overwrite").parquet(f"{path}/bits-{seqnum}")
    _write_meta(spark, path, (*row, seqnum))


def load(spark: SparkSession, path: str, entries: int | None = None, error: float | None = None, family: str | None = None) -> Model:
    """Read a filter; raises if it is unfinished or its parameters differ from the given ones."""
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no model in {path}")
    m = spark.read.schema(META).parquet(f"{path}/meta").first()
    if m is None or m["disk_seqnum"] != m["mem_seqnum"]:
        raise ValueError("the model was not written to its end")
    for name, want, got in (("capacity", entries, m["capacity"]), ("error rate", error, m["error_rate"]), ("hash family", family, m["family"])):
        if want is not None and want != got:
            raise ValueError(f"the model's {name} is {got}, not {want}")
    bits = spark.read.parquet(f"{path}/bits-{m['mem_seqnum']}")
    return Model(bits, bloom_params(m["capacity"], m["error_rate"]), m["family"], m["max_id"], m["mem_seqnum"])


def kind_of(spark: SparkSession, path: str) -> str:
    """``fixed``, ``counting`` or ``scaling``; raises if there is no finished model."""
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no model in {path}")
    m = spark.read.schema(META).parquet(f"{path}/meta").first()
    if m is None or m["disk_seqnum"] != m["mem_seqnum"]:
        raise ValueError("the model was not written to its end")
    return m["kind"]


def unknown(df: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose key the saved filter, fixed or scaling, doesn't know."""
    spark = df.sparkSession
    if kind_of(spark, path) == "scaling":
        bits, levels = load_scaling(spark, path)
        return scaling_anti(df, key, bits, levels, family_of(spark.read.schema(META).parquet(f"{path}/meta").first()["family"]))
    m = load(spark, path)
    return bloom.anti(df, key, m.positions, m.params, family_of(m.family))


def incremental_unique(df: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """First occurrences that the saved filter doesn't know, with their order; the filter itself stays as it is."""
    return unknown(first_occurrences(df, key, order), key, path)


def extend(df: DataFrame, key: str, order: str, path: str, new_max_id: int) -> None:
    """Add the keys of ``df``, whose orders lie above those of the model, to a fixed filter, and write the next number."""
    m = load(df.sparkSession, path)
    more = bloom.build(df.withColumn(order, F.col(order).cast("bigint")), key, order, m.params, family_of(m.family))
    save(bloom.merged(m.positions, more), path, m.params, m.family, new_max_id, m.seqnum + 1)


def extended(df: DataFrame, key: str, order: str, path: str, into: str) -> None:
    """Adds the keys of ``df`` to the saved filter of ``path`` and saves the result under ``into``, which may be the same.

    A fixed filter keeps its size. A scaling filter goes on with further sub-filters for the keys that it
    doesn't know. Orders of ``df`` count from the highest order of the model on.
    """
    spark = df.sparkSession
    kind = kind_of(spark, path)
    old = spark.read.schema(META).parquet(f"{path}/meta").first()
    seqnum = old["mem_seqnum"] + 1
    shifted = df.withColumn(order, F.col(order).cast("bigint") + F.lit(old["max_id"]))
    top = int(shifted.agg(F.max(order)).first()[0] or old["max_id"])
    if kind == "scaling":
        bits, levels = load_scaling(spark, path)
        family = family_of(old["family"])
        fresh = scaling_anti(shifted.select(key, order), key, bits, levels, family)
        if not fresh.take(1):
            more = ScalingResult(fresh, bits, levels)
        else:
            got = scaling_unique(fresh, key, order, old["capacity"], old["error_rate"], family, first_level=levels[-1].level + 1)
            first = got.levels[0]
            began = int(fresh.agg(F.min(order)).first()[0])
            more = ScalingResult(got.accepted, bits.unionByName(got.model.select(*bits.columns)), [*levels, Level(first.level, first.params, began, first.count), *got.levels[1:]])
        save_scaling(more, into, old["family"], top, seqnum, old["error_rate"])
    else:
        m = load(spark, path)
        new = bloom.build(shifted, key, order, m.params, family_of(m.family))
        save(bloom.merged(m.positions, new), into, m.params, m.family, top, seqnum)


LEVELS = "level int, capacity bigint, error_rate double, hashes int, per_hash bigint, start_id bigint, count bigint"


def save_counters(counts: DataFrame, path: str, params: BloomParams, family: str = "xxhash64", seqnum: int = 1) -> None:
    """Write a counting filter (``pos``, ``n``) under ``path``."""
    spark = counts.sparkSession
    row = ("counting", params.entries, params.error, params.bits, params.hashes, family, 0, seqnum)
    _write_meta(spark, path, (*row, 0))
    counts.select("pos", "n").write.mode("overwrite").parquet(f"{path}/bits-{seqnum}")
    _write_meta(spark, path, (*row, seqnum))


def save_scaling(result: ScalingResult, path: str, family: str = "xxhash64", max_id: int = 0, seqnum: int = 1, error: float | None = None) -> None:
    """Write the positions and levels of a scaling filter under ``path``."""
    spark = result.model.sparkSession
    first = result.levels[0].params
    row = ("scaling", first.capacity, first.error * 2 if error is None else error, 0, 0, family, max_id, seqnum)
    _write_meta(spark, path, (*row, 0))
    result.model.select("level", "pos", "min_order").write.mode("overwrite").parquet(f"{path}/bits-{seqnum}")
    rows = [(v.level, v.params.capacity, v.params.error, v.params.hashes, v.params.per_hash, v.start, v.count) for v in result.levels]
    spark.createDataFrame(rows, LEVELS).coalesce(1).write.mode("overwrite").parquet(f"{path}/levels-{seqnum}")
    _write_meta(spark, path, (*row, seqnum))


def load_scaling(spark: SparkSession, path: str, capacity: int | None = None, error: float | None = None, family: str | None = None) -> tuple[DataFrame, list[Level]]:
    """Positions and levels of a saved scaling filter; raises if a given capacity, error rate or family differs."""
    m = spark.read.schema(META).parquet(f"{path}/meta").first()
    if m is None or m["disk_seqnum"] != m["mem_seqnum"]:
        raise ValueError("the model was not written to its end")
    other = (capacity is not None and m["capacity"] != capacity) or (family is not None and m["family"] != family)
    if m["kind"] != "scaling" or other or (error is not None and abs(m["error_rate"] - error) > 1e-12):
        raise ValueError("the model has other parameters")
    rows = spark.read.schema(LEVELS).parquet(f"{path}/levels-{m['mem_seqnum']}").orderBy("level").collect()
    levels = [Level(r["level"], ScalingParams(r["capacity"], r["error_rate"], r["hashes"], r["per_hash"]), r["start_id"], r["count"]) for r in rows]
    return spark.read.parquet(f"{path}/bits-{m['mem_seqnum']}"), levels
