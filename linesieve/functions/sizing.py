"""Sizes of filters from the number of keys and the error rate."""

from __future__ import annotations

import math
from dataclasses import dataclass

LN2 = math.log(2.0)
MOST_ENTRIES = (2**64 - 1) // 64
MOST_COUNTERS = (2**32 - 1) // 100


@dataclass(frozen=True)
class BloomParams:
    """A fixed filter: ``bits`` positions, ``hashes`` positions a key, ``bpe`` bits an entry."""

    entries: int
    error: float
    bits: int
    bpe: float
    bytes: int
    hashes: int

    @property
    def word_bytes(self) -> int:
        """Size as an array of 64-bit words."""
        return -(-self.bits // 64) * 8


@dataclass(frozen=True)
class ScalingParams:
    """A sliced counting filter: one slice of ``per_hash`` counters for each of ``hashes`` functions."""

    capacity: int
    error: float
    hashes: int
    per_hash: int

    @property
    def size(self) -> int:
        return self.hashes * self.per_hash


def bloom_params(entries: int, error: float) -> BloomParams:
    if not 1000 <= entries <= MOST_ENTRIES:
        raise ValueError("a filter holds 1000 entries at least")
    if not 0.0 < error < 1.0:
        raise ValueError("the error rate lies between 0 and 1")
    bpe = -math.log(error) / LN2**2
    bits = int(entries * bpe)
    return BloomParams(entries, error, bits, bpe, -(-bits // 8), math.ceil(LN2 * bpe))


def scaling_params(capacity: int, error: float) -> ScalingParams:
    if not 1000 <= capacity <= MOST_COUNTERS:
        raise ValueError(f"a counting filter holds 1000 to {MOST_COUNTERS} entries")
    if not 0.0 < error < 1.0:
        raise ValueError("the error rate lies between 0 and 1")
    hashes = math.ceil(math.log2(1.0 / error))
    return ScalingParams(capacity, error, hashes, math.ceil(capacity * abs(math.log(error)) / (hashes * LN2**2)))


def level_error(error: float, level: int) -> float:
    """Error rate of sub-filter ``level`` (from 0): halved each time, so that all together stay below ``error``."""
    return error * 0.5 ** (level + 1)


def expected_fpr(keys: int, bits: int, hashes: int) -> float:
    """Chance of a wrong hit in a filter that holds ``keys`` keys."""
    return (1.0 - math.exp(-hashes * keys / bits)) ** hashes
