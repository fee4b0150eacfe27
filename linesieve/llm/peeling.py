"""Immutable fingerprint filters built by peeling a random 3-uniform hypergraph (xor filters).

A filter over n keys has three segments of about 0.41 n slots. Each key owns one slot per segment;
the slots are assigned in reverse peeling order so that the xor of a key's three slots equals its
fingerprint. Members always answer True; any other key answers True with probability 2**-bits.
All steps work on whole numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_TYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}
_GOLDEN, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((_GOLDEN * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
        return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, seed: int, segment: int) -> np.ndarray:
    h = _mix(keys, seed)
    low = np.uint64(0x1FFFFF)
    parts = [(h >> np.uint64(21 * i)) & low for i in range(3)]
    if segment > 1 << 16:  # 21 bits are too coarse for large segments
        parts = [_mix(keys, seed * 3 + 101 + i) >> np.uint64(32) for i in range(3)]
        return np.stack([((p * np.uint64(segment)) >> np.uint64(32)) + np.uint64(i * segment) for i, p in enumerate(parts)]).astype(np.int64)
    return np.stack([((p * np.uint64(segment)) >> np.uint64(21)) + np.uint64(i * segment) for i, p in enumerate(parts)]).astype(np.int64)


def _prints(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return (_mix(keys, seed + 7919) >> np.uint64(64 - bits)).astype(_TYPES[bits])


@dataclass(frozen=True)
class PeelingFilter:
    """Sealed filter; ``table`` holds the three segments one after another."""

    seed: int
    segment: int
    bits: int
    n_keys: int
    table: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, bits: int = 16) -> PeelingFilter:
        """Build over distinct or repeated 64-bit keys. An empty filter contains nothing."""
        if bits not in _TYPES:
            raise ValueError("bits must be 8, 16 or 32")
        keys = np.unique(np.asarray(keys).astype(np.int64, copy=False)).view(np.uint64)
        n = len(keys)
        if n == 0:
            return cls(0, 0, bits, 0, np.zeros(0, _TYPES[bits]))
        segment = int(0.41 * n) + 12
        for seed in range(1, 64):
            at = _slots(keys, seed, segment)
            order = cls._peel(at, 3 * segment)
            if order is not None:
                break
        else:  # practically unreachable: each seed fails with small probability
            raise RuntimeError("no seed peels these keys")
        table = np.zeros(3 * segment, _TYPES[bits])
        prints = _prints(keys, seed, bits)
        for rows, own in reversed(order):
            a, b, c = at[:, rows]
            table[own] = 0
            table[own] = prints[rows] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, segment, bits, n, table)

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (key rows, the slot each of them owns), or None if a core remains."""
        n = at.shape[1]
        degree = np.bincount(at.ravel(), minlength=size)
        holder = np.zeros(size, np.int64)  # xor of the rows that touch a slot
        rows = np.arange(n, dtype=np.int64)
        for i in range(3):
            np.bitwise_xor.at(holder, at[i], rows)
        gone, done = 0, []
        free = np.flatnonzero(degree == 1)
        while len(free):
            got, first = np.unique(holder[free], return_index=True)
            own = free[first]
            done.append((got, own))
            gone += len(got)
            touched = at[:, got]
            np.subtract.at(degree, touched.ravel(), 1)
            for i in range(3):
                np.bitwise_xor.at(holder, touched[i], got)
            near = np.unique(touched.ravel())
            free = near[degree[near] == 1]
        return done if gone == n else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.int64, copy=False).view(np.uint64)
        if self.n_keys == 0:
            return np.zeros(len(keys), bool)
        a, b, c = _slots(keys, self.seed, self.segment)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == _prints(keys, self.seed, self.bits)

    @property
    def error(self) -> float:
        return 2.0**-self.bits if self.n_keys else 0.0

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, seed: int, segment: int, bits: int, n_keys: int, blob: bytes) -> PeelingFilter:
        return cls(seed, segment, bits, n_keys, np.frombuffer(blob, _TYPES[bits]))
