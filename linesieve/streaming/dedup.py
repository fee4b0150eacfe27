"""Deduplication of streams: exact, exact within a watermark, and with Bloom filters as bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.sizing import bloom_params


def unique_stream(lines: DataFrame, key: str) -> DataFrame:
    """Each key once, with its first row; the state grows with the distinct keys."""
    return lines.dropDuplicates([key])


def unique_within(lines: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Each key at most once within ``delay`` of event time; older keys leave the state, later rows of them are new."""
    timed = lines.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def bloom_unique_stream(lines: DataFrame, key: str, capacity: int, error: float, buckets: int = 64) -> DataFrame:
    """Keys that filters of bounded size call new, as a stream of ``line``.

    Each bucket of keys has a filter for its share of ``capacity``; its state is a bit array of fixed length,
    whatever passes. A key is emitted at most once; a new key is lost with about the error rate while no more
    than ``capacity`` keys have passed. Nulls are one key.
    """
    params = bloom_params(max(1000, -(-capacity // buckets)), error)
    n_bytes, k, m = params.bytes, params.hashes, params.bits

    def step(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(state.get[0], np.uint8).copy() if state.exists else np.zeros(n_bytes, np.uint8)
        for pdf in parts:
            pdf = pdf.drop_duplicates(["h1", "h2"])
            a, b = pdf["h1"].to_numpy(np.int64) % m, pdf["h2"].to_numpy(np.int64) % m
            at = (a[:, None] + np.arange(k)[None, :] * b[:, None]) % m
            byte, mask = at >> 3, (1 << (at & 7)).astype(np.uint8)
            new = ((bits[byte] & mask) == 0).any(axis=1)
            rows = np.flatnonzero(new)
            # Rows that share no position with another open row settle each by themselves, all at once.
            _, where, times = np.unique(at[rows], return_inverse=True, return_counts=True)
            shared = (times[where.reshape(at[rows].shape)] > 1).any(axis=1)
            for i in rows[shared]:  # in turn, since a key sees what the one before it set
                new[i] = ((bits[byte[i]] & mask[i]) == 0).any()
                np.bitwise_or.at(bits, byte[i], mask[i])
            np.bitwise_or.at(bits, byte[rows[~shared]], mask[rows[~shared]])
            yield pd.DataFrame({"line": pdf["line"][new]})
        state.update((bits.tobytes(),))

    mask = F.lit((1 << 62) - 1).cast("bigint")
    hashed = lines.select(F.col(key).alias("line"), F.xxhash64(F.col(key)).bitwiseAND(mask).alias("h1"), F.xxhash64(F.lit(1), F.col(key)).bitwiseAND(mask).alias("h2"))
    keyed = hashed.withColumn("bucket", F.col("h1") % buckets)
    return keyed.groupBy("bucket").applyInPandasWithState(step, "line string", "bits binary", "append", GroupStateTimeout.NoTimeout)
