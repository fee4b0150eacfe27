"""Has this key been seen before? Generations of sealed peeling filters in place of all earlier keys.

Keys are spread over buckets by hash. Inside a bucket the batches pass in order: the keys of the
current batch are handled exactly, every earlier batch is present only as an immutable fingerprint
filter (32, 16 or 8 bits a key times 1.23), and when a batch ends, the keys that no earlier filter
knew are sealed into a filter of their own. A key is probed against all earlier generations, so the
chance of a wrong "seen" is 1 - prod(1 - 2**-bits) over those generations; "new" is never wrong
for a key whose earlier occurrences were sealed, because filters have no false negatives.

Rows are reduced to one per (batch, key) before they are spread, so a key that fills a third of the
input reaches its bucket once per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, key128, slots
from .peeling import PeelingFilter

VERDICT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("batch", T.LongType()),
    T.StructField("seen", T.BooleanType()),
    T.StructField("generations", T.IntegerType()),
    T.StructField("chance_wrong", T.DoubleType()),
])
STORE = T.StructType([
    T.StructField("bucket", T.IntegerType()),
    T.StructField("generation", T.LongType()),
    T.StructField("seed", T.LongType()),
    T.StructField("segment", T.LongType()),
    T.StructField("bits", T.IntegerType()),
    T.StructField("n_keys", T.LongType()),
    T.StructField("table", T.BinaryType()),
])


def compounded(filters: list[PeelingFilter]) -> float:
    """Chance that at least one of the filters answers wrongly for a new key."""
    return float(1.0 - np.prod([1.0 - f.error for f in filters])) if filters else 0.0


def filled(filters: list[PeelingFilter]) -> int:
    """Generations that can answer wrongly; an empty one never does."""
    return sum(f.n_keys > 0 for f in filters)


def probe(filters: list[PeelingFilter], keys: np.ndarray) -> np.ndarray:
    """Newest generation first; keys already known are not probed again."""
    known = np.zeros(len(keys), bool)
    for f in reversed(filters):
        open_ = np.flatnonzero(~known)
        if not len(open_):
            break
        known[open_[f.contains(keys[open_])]] = True
    return known


def _fold(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Both halves of the identity enter the 64 bits that a filter works on."""
    return h1 ^ ((h2 << 23) | ((h2 >> 41) & 0x7FFFFF))


def _scan(bits: int):
    """A task sees its bucket sorted by batch and holds filters, plus the keys of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list[PeelingFilter] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        now: int | None = None

        def close() -> pa.RecordBatch | None:
            ids = np.concatenate([p[0] for p in parts])
            keys = np.concatenate([p[1] for p in parts])
            seen, chance, n = probe(filters, keys), compounded(filters), filled(filters)
            filters.append(PeelingFilter.build(keys[~seen], bits))
            if now == HISTORY:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), now, np.int64)), pa.array(seen), pa.array(np.full(len(ids), n, np.int32)), pa.array(np.where(seen, chance, 0.0))],
                names=VERDICT.names,
            )

        for rb in batches:
            batch, ids, h1, h2 = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keys = _fold(h1, h2)
            edges = [0, *(np.flatnonzero(np.diff(batch)) + 1), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts and batch[a] != now:
                    if (out := close()) is not None:
                        yield out
                    parts = []
                now = int(batch[a])
                parts.append((ids[a:b], keys[a:b]))
        if parts and (out := close()) is not None:
            yield out

    return run


#: Batch number of the keys that precede all batches, and of rows whose batch is null (before all other batches).
HISTORY, NULL_BATCH = -(2**62), -(2**61)


def first_in_batch(items: DataFrame, *, id_col: str, batch_col: str, key_col: str) -> DataFrame:
    """One row (batch, id, h1, h2) per batch and key: its smallest id. Null keys fall away."""
    h1, h2 = key128(F.col(key_col))
    return (
        items.where(F.col(key_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.coalesce(F.col(batch_col).cast("long"), F.lit(NULL_BATCH)).alias("batch"), F.col(id_col).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"))
        .groupBy("batch", "h1", "h2")
        .agg(F.min("id").alias("id"))
        .select("batch", "id", "h1", "h2")
    )


def verdicts(items: DataFrame, history: DataFrame | None = None, *, id_col: str = "item_id", batch_col: str = "batch_id", key_col: str = "line", history_key: str = "line", bits: int = 32, keys_per_bucket: int = 250_000) -> DataFrame:
    """A verdict for the first row of each key in each batch (later rows of a batch repeat it exactly).

    ``id_col`` must grow with the batch order. Null keys get no verdict; the empty string is a key. Rows with a null id are left out, a null batch comes before all others. Empty inputs give an empty result; other columns are ignored.
    """
    firsts = first_in_batch(items, id_col=id_col, batch_col=batch_col, key_col=key_col)
    if history is not None:
        h1, h2 = key128(F.col(history_key))
        known = history.where(F.col(history_key).isNotNull()).select(h1.alias("h1"), h2.alias("h2")).distinct()
        firsts = firsts.unionByName(known.select(F.lit(HISTORY).cast("long").alias("batch"), F.lit(-1).cast("long").alias("id"), "h1", "h2"))
    firsts = cut(firsts)
    buckets = max(slots(items.sparkSession), -(-firsts.count() // keys_per_bucket))
    return firsts.repartition(buckets, "h1").sortWithinPartitions("batch").mapInArrow(_scan(bits), VERDICT)


def seen_before(items: DataFrame, history: DataFrame | None = None, *, id_col: str = "item_id", batch_col: str = "batch_id", key_col: str = "line", **options) -> DataFrame:
    """``id`` and ``seen`` of every row whose key and id aren't null.

    A row is new only if it is the first of its key in its batch and no earlier generation knows the key.
    """
    new = verdicts(items, history, id_col=id_col, batch_col=batch_col, key_col=key_col, **options).where(~F.col("seen")).select("id", F.lit(True).alias("new"))
    rows = items.where(F.col(key_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    return rows.join(new, "id", "left").select("id", F.col("new").isNull().alias("seen"))


def answer_rates(items: DataFrame, history: DataFrame | None = None, *, id_col: str = "item_id", batch_col: str = "batch_id", key_col: str = "line", history_key: str = "line", recorded_col: str = "is_duplicate", bits: int = 32, **options) -> DataFrame:
    """Per batch: rows, the filters' wrong answers (expected and measured) and those of a recorded verdict.

    The truth comes from an exact aggregation over all rows, kept beside the operator as a check.
    ``expected_wrong_rate`` is the chance that a new key is answered wrongly, compounded over the filled
    filters that it is probed against, ``measured_wrong_rate`` the share that was; both are of the rows
    whose key is new (``n_new``), the only ones that filters can be wrong about, and null without such rows.
    ``recorded_unknown`` counts rows whose recorded verdict is null; they are no wrong answers.
    """
    said = verdicts(items, history, id_col=id_col, batch_col=batch_col, key_col=key_col, history_key=history_key, bits=bits, **options).select("id", F.col("seen").alias("said"), "generations")
    h1, h2 = key128(F.col(key_col))
    rows = items.where(F.col(key_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(batch_col).alias("batch_id"), F.col(recorded_col).alias("recorded"), h1.alias("h1"), h2.alias("h2"))
    firsts = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    if history is not None:
        k1, k2 = key128(F.col(history_key))
        known = history.where(F.col(history_key).isNotNull()).select(k1.alias("h1"), k2.alias("h2"))
        firsts = firsts.join(known, ["h1", "h2"], "left_anti")
    truth = rows.select("id", "batch_id", "recorded").join(firsts.select("id", F.lit(True).alias("fresh")), "id", "left").withColumn("dup", F.col("fresh").isNull())
    both = truth.join(said, "id", "left").withColumn("verdict", F.coalesce("said", F.lit(True)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"),
        n(F.col("dup")).alias("n_seen_true"),
        n(F.col("verdict")).alias("n_seen_said"),
        n(F.col("verdict") & ~F.col("dup")).alias("wrong_seen"),
        n(~F.col("verdict") & F.col("dup")).alias("wrong_new"),
        n(~F.col("dup")).alias("n_new"),
        F.avg(F.when(~F.col("dup"), -F.expm1(F.col("generations") * F.lit(math.log1p(-(2.0**-bits)))))).alias("expected_wrong_rate"),
        F.avg(F.when(~F.col("dup"), F.col("verdict").cast("double"))).alias("measured_wrong_rate"),
        n(F.col("recorded") & ~F.col("dup")).alias("recorded_wrong_seen"),
        n(~F.col("recorded") & F.col("dup")).alias("recorded_wrong_new"),
        n(F.col("recorded").isNull()).alias("recorded_unknown"),
        (n(F.col("recorded") != F.col("dup")) / F.greatest(F.count("recorded"), F.lit(1))).alias("recorded_wrong_rate"),
    )


class FilterStore:
    """Sealed filters kept as a table in a shared folder, one row per bucket and generation.

    Each call of :meth:`accept` probes one batch against the stored generations and appends a new one;
    the earlier keys themselves are never read again. The number of buckets is fixed at creation.
    """

    def __init__(self, path: str, buckets: int, bits: int = 32):
        self.path, self.buckets, self.bits = path, buckets, bits

    def _stored(self, spark) -> DataFrame:
        probe_ = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = probe_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe_)
        return spark.read.schema(STORE).parquet(self.path) if there else spark.createDataFrame([], STORE)

    def accept(self, batch: DataFrame, generation: int, *, id_col: str = "item_id", key_col: str = "line") -> DataFrame:
        """``id``, ``seen`` and ``chance_wrong`` of each row with a non-null key; the new keys are sealed.

        Running a generation again replaces nothing: a stored generation of the same number is left out
        of the probe and rewritten, so that a repeated call after a failure gives the same result.
        """
        spark, bits = batch.sparkSession, self.bits
        bucket = F.pmod(F.col("h1"), F.lit(self.buckets)).cast("int")
        firsts = cut(first_in_batch(batch.select(F.col(id_col).alias("i"), F.col(key_col).alias("k"), F.lit(generation).alias("g")), id_col="i", batch_col="g", key_col="k").withColumn("bucket", bucket))
        stored = self._stored(spark).where(F.col("generation") < generation)
        out = T.StructType([*VERDICT.fields, *STORE.fields])

        def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
            filters = [PeelingFilter.from_bytes(r["seed"], r["segment"], r["bits"], r["n_keys"], r["table"]) for r in sorted(right.to_pylist(), key=lambda r: r["generation"])]
            ids = left["id"].to_numpy().astype(np.int64)
            keys = _fold(left["h1"].to_numpy().astype(np.int64), left["h2"].to_numpy().astype(np.int64))
            seen = probe(filters, keys)
            f = PeelingFilter.build(keys[~seen], bits)
            none = lambda n, t: pa.nulls(n, t)
            n = len(ids)
            rows = [pa.array(ids), pa.array(np.full(n, generation, np.int64)), pa.array(seen), pa.array(np.full(n, filled(filters), np.int32)), pa.array(np.where(seen, compounded(filters), 0.0))]
            rows += [none(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
            a = pa.Table.from_arrays(rows, names=out.names)
            one = [none(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.float64())]
            one += [pa.array([key[0].as_py()], pa.int32()), pa.array([generation], pa.int64()), pa.array([f.seed], pa.int64()), pa.array([f.segment], pa.int64()), pa.array([bits], pa.int32()), pa.array([f.n_keys], pa.int64()), pa.array([f.to_bytes()], pa.binary())]
            return pa.concat_tables([a, pa.Table.from_arrays(one, names=out.names)]) if n else a

        done = cut(firsts.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(work, out))
        kept = done.where(F.col("table").isNotNull()).select(*STORE.names)
        kept.write.mode("overwrite").parquet(f"{self.path}/part=g{generation}")
        new = done.where(F.col("id").isNotNull() & ~F.col("seen")).select("id", F.lit(True).alias("new"))
        chance = done.where(F.col("id").isNotNull()).select("id", "chance_wrong")
        rows = batch.where(F.col(key_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
        return rows.join(new, "id", "left").join(chance, "id", "left").select("id", F.col("new").isNull().alias("seen"), F.coalesce("chance_wrong", F.lit(0.0)).alias("chance_wrong"))
