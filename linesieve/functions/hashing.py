"""Hash families: two 64-bit halves of a key, and the filter positions made of them by double hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published 128-bit x64 variant of MurmurHash3.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_ADD1, _ADD2 = 0x52DCE729, 0x38495AB5
_FMIX1, _FMIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Seeds of the fixed and of the scaling filter.
FIXED_SEED, SCALING_SEED = 0x9747B28C, 0x97C29B3A
_ALL = 0xFFFFFFFFFFFFFFFF


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _ALL


def _finish(x: int) -> int:
    for factor in (_FMIX1, _FMIX2):
        x = ((x ^ (x >> 33)) * factor) & _ALL
    return x ^ (x >> 33)


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64 128 of a byte string as two unsigned numbers."""

    def scramble(word: int, first: bool) -> int:
        a, r, b = (_C1, 31, _C2) if first else (_C2, 33, _C1)
        return (_rotate((word * a) & _ALL, r) * b) & _ALL

    h = [seed, seed]
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        low, high = (int.from_bytes(data[at + k : at + k + 8], "little") for k in (0, 8))
        h[0] = (((_rotate(h[0] ^ scramble(low, True), 27) + h[1]) & _ALL) * 5 + _ADD1) & _ALL
        h[1] = (((_rotate(h[1] ^ scramble(high, False), 31) + h[0]) & _ALL) * 5 + _ADD2) & _ALL
    tail = data[whole:]
    h[1] ^= scramble(int.from_bytes(tail[8:], "little"), False)
    h[0] ^= scramble(int.from_bytes(tail[:8], "little"), True)
    h = [h[0] ^ len(data), h[1] ^ len(data)]
    h[0] = (h[0] + h[1]) & _ALL
    h[1] = (h[1] + h[0]) & _ALL
    h = [_finish(h[0]), _finish(h[1])]
    h[0] = (h[0] + h[1]) & _ALL
    h[1] = (h[1] + h[0]) & _ALL
    return h[0], h[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def murmur3_positions(data: bytes, hashes: int, bits: int, seed: int = FIXED_SEED) -> list[int]:
    """Positions (a + i b) mod 2**64 mod bits, all unsigned, of a fixed filter."""
    a, b = murmur3_128(data, seed)
    return [((a + i * b) & _ALL) % bits for i in range(hashes)]


def sliced_positions(data: bytes, hashes: int, per_hash: int, seed: int = SCALING_SEED) -> list[int]:
    """Positions of a sliced filter: (h1 + i h2) mod 2**32 mod per_hash within slice i, from the low halves of the first word."""
    first = murmur3_128(data, seed)[0]
    h1, h2 = first & 0xFFFFFFFF, first >> 32
    return [((h1 + i * h2) & 0xFFFFFFFF) % per_hash + i * per_hash for i in range(hashes)]


def murmur3_arrays(keys: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`murmur3_128` of many keys as two arrays; keys of one length are hashed together."""
    u = np.uint64
    c1, c2 = u(_C1), u(_C2)
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    low_word = lambda w: turn(w * c1, 31) * c2
    high_word = lambda w: turn(w * c2, 33) * c1

    def finish(x: np.ndarray) -> np.ndarray:
        for factor in (_FMIX1, _FMIX2):
            x = (x ^ (x >> u(33))) * u(factor)
        return x ^ (x >> u(33))

    lengths = np.array([len(k) for k in keys], np.int64)
    first, second = np.zeros(len(keys), u), np.zeros(len(keys), u)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        words = max(2, -(-int(length) // 16) * 2)
        raw = np.zeros((len(rows), words * 8), np.uint8)
        if length:
            raw[:, :length] = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), length)
        w = raw.view("<u8")
        a, b = np.full(len(rows), seed, u), np.full(len(rows), seed, u)
        whole = int(length) // 16
        for k in range(whole):
            a = (turn(a ^ low_word(w[:, 2 * k]), 27) + b) * u(5) + u(_ADD1)
            b = (turn(b ^ high_word(w[:, 2 * k + 1]), 31) + a) * u(5) + u(_ADD2)
        if length % 16 or not length:
            b = b ^ high_word(w[:, 2 * whole + 1])
            a = a ^ low_word(w[:, 2 * whole])
        a, b = a ^ u(length), b ^ u(length)
        a = a + b
        b = b + a
        a, b = finish(a), finish(b)
        first[rows] = a + b
        second[rows] = b + first[rows]
    return first, second


class HashFamily:
    """Two halves of a key column, and the positions made of them; nulls hash like any other key.

    The halves stand for the key wherever its text isn't needed: they are what travels.
    """

    name = ""

    def halves(self, key: Column) -> tuple[Column, Column]:
        """Two numbers, non-negative and below 2**62 unless the family says otherwise."""
        raise NotImplementedError

    def one(self, a: Column, b: Column, i: int, bits: int) -> Column:
        """Position ``i`` of the two halves."""
        m = F.lit(bits).cast("bigint")
        return (a % m + F.lit(i).cast("bigint") * (b % m)) % m

    def at(self, a: Column, b: Column, hashes: int, bits: int, sliced: bool = False) -> Column:
        """Positions from the two halves, as an array of plain expressions; ``sliced`` gives each its own range of ``bits``."""
        return F.array(*(self.one(a, b, i, bits) + F.lit(i * bits if sliced else 0).cast("bigint") for i in range(hashes)))

    def positions(self, key: Column, hashes: int, bits: int) -> Column:
        return self.at(*self.halves(key), hashes, bits)

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(self.halves(key)[0], F.lit(buckets)).cast("int")


class XxHash(HashFamily):
    """Built in, 64-bit, the default."""

    name = "xxhash64"

    def halves(self, key: Column) -> tuple[Column, Column]:
        mask = F.lit((1 << 62) - 1).cast("bigint")
        return F.xxhash64(key).bitwiseAND(mask), F.xxhash64(F.lit(1), key).bitwiseAND(mask)


class Md5(HashFamily):
    """The first two groups of 15 hex digits of the MD5 digest: the same in any SQL engine."""

    name = "md5"

    def halves(self, key: Column) -> tuple[Column, Column]:
        digest = F.md5(F.coalesce(key, F.lit("\x00null")).cast("binary"))
        part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
        return part(1), part(16)


class Murmur3(HashFamily):
    """The positions of the original filter bit by bit: halves through an Arrow UDF, positions as expressions."""

    name = "murmur3"

    def __init__(self, seed: int = FIXED_SEED):
        self.seed = seed

    def halves(self, key: Column) -> tuple[Column, Column]:
        """All 64 bits of both, as signed numbers."""
        seed = self.seed

        @F.pandas_udf("a bigint, b bigint")
        def both(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in keys:
                a, b = murmur3_arrays([b"\x00null" if k is None else k.encode("utf-8", "surrogatepass") for k in s], seed)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        h = both(key)
        return h["a"], h["b"]

    def one(self, a: Column, b: Column, i: int, bits: int) -> Column:
        """(a + i b) mod 2**64 mod ``bits``, below 2**47, on unsigned numbers: by words of 32 bits, reduced by 16 bits at a time."""
        word, m, i = F.lit(0xFFFFFFFF), F.lit(bits).cast("bigint"), F.lit(i).cast("bigint")
        low, high = (lambda x: x.bitwiseAND(word)), (lambda x: F.shiftrightunsigned(x, 32))
        under = low(a) + i * low(b)
        over = (high(a) + i * high(b) + F.shiftright(under, 32)).bitwiseAND(word)
        under = under.bitwiseAND(word)
        first = (over % m * F.lit(65536) + F.shiftright(under, 16)) % m
        return (first * F.lit(65536) + under.bitwiseAND(F.lit(65535))) % m


def family(name: str) -> HashFamily:
    return {"xxhash64": XxHash, "md5": Md5, "murmur3": Murmur3}[name]()
