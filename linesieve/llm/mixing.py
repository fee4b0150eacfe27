"""Mixing sources to target weights by balanced sampling (the cube method).

Each record of a source is wanted r times on average: r = wanted tokens / available tokens, at most the
source's cap. The whole part is given to every record; the fraction is decided by the cube method: the
vector of fractions moves through the null space of the balancing constraints (tokens and documents)
until components reach 0 or 1. Three records always leave a direction that keeps both totals, so a block
of records ends with at most two undecided ones. Blocks are flown independently, the undecided records of
all blocks are flown again together, and the last two are landed at the rounding nearest to the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_EPS = 1e-9
_FLOWN = "source string, id bigint, n_tokens bigint, p double"


def fly(tokens: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase over one block: probabilities of 0 or 1 but for at most two; token and document sums are kept."""
    rng = np.random.default_rng(seed)
    coin = rng.random(len(p) + 1).tolist()
    p, t = p.astype(float).tolist(), tokens.astype(float).tolist()
    live: list[int] = []
    used = 0
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            live.append(i)
        while len(live) >= 3:
            a, b, c = live[0], live[1], live[2]
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if u[0] == 0 and u[1] == 0 and u[2] == 0:
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, x in zip((a, b, c), u):
                if x > 0:
                    up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
                elif x < 0:
                    up, down = min(up, -p[k] / x), min(down, -(1 - p[k]) / x)
            go = up if coin[used % len(coin)] * (up + down) < down else -down
            used += 1
            for k, x in zip((a, b, c), u):
                p[k] += go * x
            live = [k for k in live if _EPS < p[k] < 1 - _EPS]
            if len(live) == 3:  # rounding kept all three inside: settle the nearest
                k = min(live, key=lambda j: min(p[j], 1 - p[j]))
                p[k] = float(round(p[k]))
                live.remove(k)
    out = np.array(p)
    out[out < _EPS] = 0.0
    out[out > 1 - _EPS] = 1.0
    return out


def land(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Landing phase: the undecided records take the rounding nearest in tokens, then in documents.

    What this misses in tokens is then mended, as far as possible, by exchanging a chosen record for another
    one, or by adding or dropping one record, whichever comes nearest; each step must come nearer.
    """
    want, docs = float((tokens * p).sum()), float(p.sum())
    p = p.copy()
    free = np.flatnonzero((p > 0) & (p < 1))
    while len(free) > 8:  # only for callers that skip the flight
        p[free[0]] = float(round(p[free[0]]))
        free = free[1:]
    if len(free):
        t, w, d = tokens[free].astype(float), float((tokens[free] * p[free]).sum()), float(p[free].sum())
        picks = [np.array([(m >> i) & 1 for i in range(len(free))], float) for m in range(1 << len(free))]
        p[free] = min(picks, key=lambda x: (abs(float((t * x).sum()) - w), abs(float(x.sum()) - d)))
    while True:  # ends, since each step comes nearer and there are finitely many choices
        miss = want - float((tokens * p).sum())
        ways = [(abs(miss), 0.0, ())]
        ins, outs = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(miss) < 0.5:
            break
        if len(outs):
            i = int(outs[np.argmin(np.abs(tokens[outs] - miss))])
            ways.append((abs(miss - tokens[i]), abs(p.sum() + 1 - docs), (i,)))
        if len(ins):
            i = int(ins[np.argmin(np.abs(tokens[ins] + miss))])
            ways.append((abs(miss + tokens[i]), abs(p.sum() - 1 - docs), (i,)))
        if len(outs) and len(ins):
            by = outs[np.argsort(tokens[outs], kind="stable")]
            at = np.searchsorted(tokens[by], tokens[ins] + miss)
            for shift in (-1, 0):
                j = by[np.clip(at + shift, 0, len(by) - 1)]
                left = np.abs(tokens[ins] + miss - tokens[j])
                k = int(np.argmin(left))
                ways.append((float(left[k]), abs(p.sum() - docs), (int(ins[k]), int(j[k]))))
        change = min(ways)[2]
        if not change:
            break
        for i in change:
            p[i] = 1.0 - p[i]
    return p


def _block(last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        tokens = rows["n_tokens"].to_numpy()
        seed = int(np.abs(hash((key[1].as_py(), int(rows["id"][0].as_py()))))) & 0x7FFFFFFF
        p = fly(tokens, rows["p"].to_numpy(), seed)
        if last:
            p = land(tokens, p)
        return pa.table([rows["source"], rows["id"], rows["n_tokens"], pa.array(p)], names=["source", "id", "n_tokens", "p"])

    return run


def normal_source(name: Column) -> Column:
    """Sources are spelled unevenly: case, surrounding blanks, and ``-`` or blanks for ``_``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-\s]+", "_")


def rates(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None, tolerance: float = 0.0) -> dict[str, float]:
    """Times that a record of each source is wanted on average; a source stops at its cap.

    Shares of sources without records are spread over the others in proportion. With ``total``, so many
    tokens are aimed at. Without it, the mixture is the largest in which the share of no source that has
    records is further than ``tolerance`` from its (spread) target: at 0, every source reaches it.
    """
    there = {s: (share, cap) for s, (share, cap) in targets.items() if available.get(s, 0) > 0 and share > 0 and cap > 0}
    if not there:
        return {}
    whole = sum(share for share, _ in there.values())
    at = lambda total: {s: min(float(cap), total * share / whole / available[s]) for s, (share, cap) in there.items()}
    if total is not None:
        return at(total)
    full = sorted(cap * available[s] * whole / share for s, (share, cap) in there.items())
    low, high = full[0], full[-1]  # beyond the last, all sources are at their caps
    if deviation(available, there, at(high)) <= tolerance:
        return at(high)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if deviation(available, there, at(mid)) <= tolerance else (low, mid)
    return at(low)


def deviation(available: dict[str, float], targets: dict[str, tuple[float, int]], rate: dict[str, float]) -> float:
    """Largest distance of the share of a source that has records from its target, spread over these sources."""
    whole = sum(targets[s][0] for s in rate)
    total = sum(rate[s] * available[s] for s in rate)
    return max(abs(rate[s] * available[s] / total - targets[s][0] / whole) for s in rate)


def _sums(sizes: DataFrame, targets: DataFrame) -> tuple[dict[str, tuple[float, int]], dict[str, tuple[float, int]]]:
    """(share, cap) of each target and (tokens, records) of each source that has one: a row per target reaches the driver."""
    got = {r["source"]: (float(r["share"]), int(r["cap"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy(normal_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    have = {r["source"]: (float(r["t"]), int(r["n"])) for r in sizes.where(F.col("source").isin(list(got)) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()} if got else {}
    return got, have


def tradeoff(sizes: DataFrame, targets: DataFrame, tolerances: tuple[float, ...]) -> DataFrame:
    """For each tolerance: tokens of the mixture, their share of all tokens of the sources, the largest deviation reached, and the sources at their cap."""
    got, have = _sums(sizes.select("id", normal_source(F.col("source")).alias("source"), "n_tokens").where("id is not null"), targets)
    tokens = {s: t for s, (t, _) in have.items()}
    rows = []
    for tolerance in tolerances:
        rate = rates(tokens, got, tolerance=tolerance)
        if rate:
            total = sum(rate[s] * tokens[s] for s in rate)
            rows.append((tolerance, int(total), total / sum(tokens.values()), deviation(tokens, got, rate), sum(rate[s] >= got[s][1] - 1e-9 for s in rate)))
    return sizes.sparkSession.createDataFrame(rows, "tolerance double, tokens bigint, of_all double, deviation double, sources_at_cap int")


def mix(sizes: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, tolerance: float = 0.0, block: int = 50_000) -> DataFrame:
    """``id, source, n_tokens, repeats`` of every record; ``repeats`` 0 means that it isn't used.

    ``sizes``: ``id``, ``source``, ``n_tokens``; ``targets``: ``source``, ``target_share``, ``max_repeats``, a
    few rows. Sources are compared by :func:`normal_source`. Records without source, target or tokens
    have 0 repeats; rows with a null id are left out, ids are unique. ``total_tokens`` and ``tolerance``: see :func:`rates`. Ties and equal sizes need no care:
    the document constraint alone then moves the fractions.
    """
    sizes = cut(sizes.select("id", normal_source(F.col("source")).alias("source"), "n_tokens").where("id is not null"))
    got, have = _sums(sizes, targets)
    rate = rates({s: t for s, (t, _) in have.items()}, got, total_tokens, tolerance)
    if not rate:
        return sizes.withColumn("repeats", F.lit(0).cast("bigint"))
    r = F.create_map(*(x for s, v in rate.items() for x in (F.lit(s), F.lit(v))))[F.col("source")]
    wanted = sizes.withColumn("r", F.when(F.col("n_tokens") > 0, F.coalesce(r, F.lit(0.0))).otherwise(0.0))
    whole = wanted.withColumn("whole", F.floor("r"))
    parts = F.create_map(*(x for s in rate for x in (F.lit(s), F.lit(max(1, -(-have[s][1] // block))))))[F.col("source")]
    part = whole.where((F.col("r") - F.col("whole")) > _EPS).select("source", "id", "n_tokens", (F.col("r") - F.col("whole")).alias("p"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    blocks = max(-(-have[s][1] // block) for s in rate)
    decided = []
    while blocks > 1:  # each round leaves two records a block
        flown = cut(part.groupBy("source", "part").applyInArrow(_block(False), _FLOWN))
        decided.append(flown.where("p = 0 or p = 1"))
        blocks = -(-2 * blocks // block)
        part = flown.where("p > 0 and p < 1").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int"))
    taken = cut(part.groupBy("source", "part").applyInArrow(_block(True), _FLOWN))
    for d in decided:
        taken = taken.unionByName(d)
    extra = taken.where("p = 1").select("id", F.lit(1).alias("extra"))
    return whole.join(extra, "id", "left").select("id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source in tokens, the records and uses behind it, and the difference."""
    per = mixed.where("repeats > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"))
    per = per.withColumn("total", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    wanted = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    got = wanted.join(per, "source", "left")
    actual = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0))
    return got.select("source", "target_share", actual.alias("actual_share"), (actual - F.col("target_share")).alias("difference"), zero("tokens"), zero("records"), zero("uses"), zero("most_repeats"), "max_repeats")
