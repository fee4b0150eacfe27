"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of sizes reaches the driver (at most ``capacity`` numbers). There, patterns of a few
documents that fill a container are enumerated, repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what remains is packed by best fit on the histogram. The plan says which
ranks of a size class go to which containers; tasks look their rows up in it, so the documents themselves
are never gathered. Size classes are exact up to ``CLASSES`` tokens of capacity, else rounded upwards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Size classes of a capacity at most, and patterns enumerated for the fit at most.
CLASSES, PATTERNS = 1024, 60_000


def enumerate_patterns(present: np.ndarray, classes: int, limit: int = PATTERNS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns m x a + b + c that fill ``classes`` exactly, with m up to 6; arrays (n, 3) of classes and of repeats.

    A class of 0 stands for no document. All sizes of a pattern must be ``present``.
    """
    have = np.zeros(classes + 1, bool)
    have[present] = True
    have[0] = True
    sizes = present[present < classes]
    a_out, m_out = [], []
    left = limit
    for m in (1, 2, 3, 4, 6):
        for_m = max(1, left // 2 if m == 1 else left // 4)
        a = sizes[sizes * m <= classes]
        if not len(a):
            continue
        rest = classes - m * a
        step = max(1, int(np.ceil(rest.sum() / (6 if m == 1 else 2) / for_m)))
        b = np.arange(0, classes, step)
        A, Bm = np.meshgrid(a, b, indexing="ij")
        C = classes - m * A - Bm
        ok = (C >= 0) & (C <= Bm) & have[Bm] & have[np.clip(C, 0, classes)]
        if m == 1:
            ok &= A >= Bm
        else:
            ok &= (Bm != A) | (m == 1)
        rows = np.stack([A[ok], Bm[ok], C[ok]], axis=1)
        a_out.append(rows)
        m_out.append(np.stack([np.full(len(rows), m), (rows[:, 1] > 0).astype(int), (rows[:, 2] > 0).astype(int)], axis=1))
        left = max(1000, left - len(rows))
    if not a_out:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    return np.concatenate(a_out).astype(np.int64), np.concatenate(m_out).astype(np.int64)


def nnls(sizes: np.ndarray, repeats: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising |W (A x - target)|, by accelerated projected gradient; column p of A has ``repeats[p]`` at ``sizes[p]``.

    W weighs a class by its size: a large document left over wastes more and is harder to place.
    """
    n, size = len(sizes), len(target)
    flat, weight = sizes.ravel(), repeats.astype(float).ravel()
    w = np.arange(size) / size
    weight = np.where(flat > 0, weight, 0.0) * w[flat]
    target = target * w
    forward = lambda x: np.bincount(flat, weight * np.repeat(x, 3), size)
    back = lambda y: (weight * y[flat]).reshape(n, 3).sum(axis=1)
    v = np.ones(n) / np.sqrt(n)
    big = 1.0
    for _ in range(30):
        v = back(forward(v))
        big = float(np.linalg.norm(v)) or 1.0
        v /= big
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, z - back(forward(z) - target) / (1.02 * big))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


@dataclass
class Plan:
    """Rank intervals: ranks ``lo`` .. ``hi`` of a class go to containers ``first`` + (rank - lo) // repeats."""

    capacity: int
    unit: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    by_pattern: int = 0

    def size_class(self, lengths):
        return (lengths + self.unit - 1) // self.unit


def make_plan(capacity: int, lengths: np.ndarray, counts: np.ndarray) -> Plan:
    """Plan for pieces of the given distinct ``lengths`` (1 .. capacity) with their ``counts``.

    Ranks run within a class by length. An empty histogram gives an empty plan.
    """
    plan = Plan(capacity, -(-capacity // CLASSES))
    if not len(lengths):
        return plan
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    classes = capacity // plan.unit
    cls = plan.size_class(lengths)
    fits = cls <= classes
    top = int(cls.max()) + 1
    hist = np.bincount(cls, counts, top).astype(np.int64)
    target = np.zeros(classes + 1)
    upto = min(top, classes + 1)
    target[:upto] = hist[:upto]
    taken = np.zeros(top, np.int64)
    present = np.unique(cls[fits])
    sizes, repeats = enumerate_patterns(present, classes) if len(present) else (np.zeros((0, 3), int),) * 2
    if len(sizes):
        x = nnls(sizes, repeats, target)
        free = hist.copy()
        # Systematic rounding: the running sum is rounded, so that many small repeat counts keep their weight.
        whole = np.diff(np.floor(np.r_[0.0, np.cumsum(x)] + 0.5)).astype(np.int64)
        for p in np.lexsort((-x, -whole)):
            n = int(whole[p])
            if n < 1:
                break
            need: dict[int, int] = {}
            for s, m in zip(sizes[p].tolist(), repeats[p].tolist()):
                if s > 0:
                    need[s] = need.get(s, 0) + m
            n = min([n, *(int(free[s]) // m for s, m in need.items())])
            if n < 1:
                continue
            for s, m in need.items():
                plan.rows.append((s, int(taken[s]), int(taken[s]) + n * m, plan.containers, m))
                taken[s] += n * m
                free[s] -= n * m
            plan.containers += n
        plan.by_pattern = plan.containers
    # What remains, with exact lengths, by best fit on the histogram.
    before = np.r_[0, np.cumsum(counts)]
    start = np.r_[0, np.flatnonzero(np.diff(cls)) + 1]
    base = np.zeros(top, np.int64)
    base[cls[start]] = before[start]
    open_free: list[int] = []  # sorted free spaces
    at: dict[int, list[list[int]]] = {}  # free space: [first container, number]

    def put(space: int, first: int, n: int) -> None:
        if n > 0 and space > 0:
            if space not in at:
                insort(open_free, space)
                at[space] = []
            at[space].append([first, n])

    def take(space: int, n: int) -> tuple[int, int]:
        groups = at[space]
        first, have = groups[-1]
        n = min(n, have)
        if n == have:
            groups.pop()
            if not groups:
                del at[space]
                open_free.pop(bisect_left(open_free, space))
        else:
            groups[-1] = [first + n, have - n]
        return first, n

    for i in range(len(lengths) - 1, -1, -1):
        length, c = int(lengths[i]), int(cls[i])
        lo, hi = int(before[i] - base[c]), int(before[i + 1] - base[c])
        lo = max(lo, int(taken[c]))
        n = hi - lo
        while n > 0:
            k = bisect_left(open_free, length)
            if k < len(open_free):
                space = open_free[k]
                many = min(n, space // length)
                have = at[space][-1][1]
                if n >= many * 1 and many > 1 and n >= have * many:
                    first, used = take(space, have)
                    m = many
                elif many > 1:
                    m = max(1, min(many, n // max(1, min(have, n))))
                    first, used = take(space, min(have, n // m))
                else:
                    m = 1
                    first, used = take(space, n)
                plan.rows.append((c, lo, lo + used * m, first, m))
                put(space - m * length, first, used)
                lo += used * m
                n -= used * m
            else:
                m = min(n, capacity // length)
                used = n // m
                plan.rows.append((c, lo, lo + used * m, plan.containers, m))
                put(capacity - m * length, plan.containers, used)
                plan.containers += used
                lo += used * m
                n -= used * m
    return plan


def _look_up(plans: dict[str, tuple[int, int, np.ndarray]]):
    """Adds the container of each row (kind, cls, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            kinds = rb.column(0).dictionary_encode()
            cls, rank = rb.column(1).to_numpy(), rb.column(2).to_numpy()
            out = np.full(rb.num_rows, -1, np.int64)
            code = kinds.indices.to_numpy()
            for k, kind in enumerate(kinds.dictionary.to_pylist()):
                rows = np.flatnonzero(code == k)
                shift, key, plan = plans[kind]
                i = np.searchsorted(key, (cls[rows].astype(np.int64) << shift) | rank[rows], side="right") - 1
                out[rows] = plan[i, 3] + (rank[rows] - plan[i, 1]) // plan[i, 4]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(rb.column(i) for i in range(3, rb.num_columns)), pa.array(out)], names=["container_kind", "doc_id", "piece", "start", "n_tokens", "container"])

    return run


_PLACED = "container_kind string, doc_id bigint, piece bigint, start bigint, n_tokens bigint, container bigint"


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Placement of every piece: ``container_kind, container_id, doc_id, piece, start, n_tokens``.

    ``sizes``: ``id``, ``n_tokens``; ``containers``: ``container_kind``, ``capacity_tokens``, a few rows,
    each a separate task over all documents. A text is split only if it exceeds the capacity alone: into
    full containers and one rest, which is packed like any other piece. Texts of no tokens (null or empty)
    take no space and get no row; a null or non-positive capacity or a null name is no task. Ids are unique;
    rows with a null id are left out. Container ids are ``p...`` (packed) or ``f...`` (filled by one piece).
    """
    spark = sizes.sparkSession
    kinds = [(r[0], int(r[1])) for r in containers.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()]
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container_id string, doc_id bigint, piece bigint, start bigint, n_tokens bigint")
    sizes = cut(sizes.where("n_tokens > 0 and id is not null").select("id", "n_tokens"))
    caps = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds))
    each = sizes.select("id", "n_tokens", F.explode(caps).alias("k")).select("id", "n_tokens", "k.kind", "k.cap")
    whole = F.when(F.col("n_tokens") > F.col("cap"), F.expr("n_tokens div cap")).otherwise(0)
    each = each.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("cap"))
    rests = each.where("rest > 0").select("kind", F.col("rest").alias("len"), "id", F.col("whole").alias("piece"), (F.col("whole") * F.col("cap")).alias("start"))
    salts = max(32, -(-sizes.count() // 500_000))
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("kind", "len", "salt").agg(F.count("*").alias("c")))
    histogram = counts.groupBy("kind", "len").agg(F.sum("c").alias("c")).toPandas()  # at most the sum of the capacities
    plans, ready = {}, {}
    for kind, cap in kinds:
        h = histogram[histogram["kind"] == kind]
        plans[kind] = plan = make_plan(cap, h["len"].to_numpy(np.int64), h["c"].to_numpy(np.int64))
        rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
        ready[kind] = (40, (rows[:, 0] << 40) | rows[:, 1], rows)
    unit = F.create_map(*(x for k, p in plans.items() for x in (F.lit(k), F.lit(p.unit))))
    within = Window.partitionBy("kind", "cls").orderBy("len", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("cls", F.ceil(F.col("len") / unit[F.col("kind")])).withColumn("offset", F.coalesce(F.sum("c").over(within), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("kind", "len", "salt").orderBy("id", "piece")) - 1
    ranked = salted.join(offsets.select("kind", "len", "salt", "cls", "offset"), ["kind", "len", "salt"]).withColumn("rank", place + F.col("offset"))
    placed = ranked.select("kind", F.col("cls").cast("long").alias("cls"), F.col("rank").cast("long").alias("rank"), "id", F.col("piece").cast("long").alias("piece"), F.col("start").cast("long").alias("start"), "len").mapInArrow(_look_up(ready), _PLACED)
    rests_out = placed.select("container_kind", F.concat(F.lit("p"), "container").alias("container_id"), "doc_id", "piece", "start", "n_tokens")
    full = each.where("whole > 0").select("kind", "cap", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    full_out = full.select(F.col("kind").alias("container_kind"), F.concat(F.lit("f"), "id", F.lit("-"), "piece").alias("container_id"), F.col("id").alias("doc_id"), "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("n_tokens"))
    return rests_out.unionByName(full_out)


def unused(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers, tokens placed, unused tokens and their share, and the least number of containers possible."""
    each = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    got = each.join(containers.select("container_kind", "capacity_tokens").distinct(), "container_kind")
    space = F.col("n_containers") * F.col("capacity_tokens")
    return (
        got.groupBy("container_kind", "capacity_tokens")
        .agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
        .withColumn("unused_tokens", space - F.col("n_tokens"))
        .withColumn("unused_share", F.col("unused_tokens") / space)
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    )
