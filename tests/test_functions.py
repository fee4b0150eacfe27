"""Hashes, sizes, name checks and escapes."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linesieve.functions import formats, hashing, sizing, validate


def test_murmur_known_answers():
    assert hashing.murmur3_128(b"") == (0, 0)
    assert hashing.murmur3_128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert hashing.murmur3_128(b"The quick brown fox jumps over the lazy dog") == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


@given(st.binary(max_size=80), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_murmur_ranges(data, seed):
    a, b = hashing.murmur3_128(data, seed)
    assert 0 <= a < 2**64 and 0 <= b < 2**64
    assert all(0 <= p < 9585 for p in hashing.murmur3_positions(data, 7, 9585))
    at = hashing.sliced_positions(data, 7, 1370)
    assert [p // 1370 for p in at] == list(range(7))


@pytest.mark.parametrize("entries,error,bits,n_bytes,hashes", [(1000, 0.01, 9585, 1199, 7), (1000, 0.1, 4792, 599, 4), (100_000, 0.001, 1437758, 179720, 10), (50_000_000, 0.01, 479252918, 59906615, 7)])
def test_fixed_sizes(entries, error, bits, n_bytes, hashes):
    p = sizing.bloom_params(entries, error)
    assert (p.bits, p.bytes, p.hashes) == (bits, n_bytes, hashes)
    assert p.word_bytes % 8 == 0 and 0 <= p.word_bytes - p.bytes < 8


@pytest.mark.parametrize("entries,error", [(999, 0.1), (1000, 0.0), (1000, 1.0), (sizing.MOST_ENTRIES + 1, 0.1)])
def test_bad_sizes(entries, error):
    with pytest.raises(ValueError):
        sizing.bloom_params(entries, error)


def test_scaling_sizes():
    p = sizing.scaling_params(1000, 0.01)
    assert p.hashes == 7 and p.per_hash == math.ceil(1000 * math.log(100) / (7 * math.log(2) ** 2))
    with pytest.raises(ValueError):
        sizing.scaling_params(999, 0.01)
    assert sum(sizing.level_error(0.01, k) for k in range(50)) < 0.01 + 1e-12


def test_families_give_positions(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("é\x00",)], "k string")
    for name in ("xxhash64", "md5", "murmur3"):
        got = df.select(hashing.family(name).positions(F.col("k"), 5, 1000).alias("p")).collect()
        assert all(len(r["p"]) == 5 and all(0 <= x < 1000 for x in r["p"]) for r in got)
        assert len({tuple(r["p"]) for r in got}) == 4
    got = df.where("k = 'a'").select(hashing.Murmur3().positions(F.col("k"), 7, 9585).alias("p")).first()["p"]
    assert got == hashing.murmur3_positions(b"a", 7, 9585)


PATHS = ["a.txt", "dir/a.txt", "/abs/a", "", None, "..", "../a", "a/../b", "a/..", "a//b", "a\n", "a\r", "tab\t", "é", "x" * 4095, "x" * 4096, "..a", "a..", "a b~"]
NAMES = ["a.txt", "", None, ".hidden", "a/b", "a\\b", "a:b", "a*", "a?", 'a"', "a<", "a>", "a|", "CON", "con", "NUL", "CONSOLE", "x" * 254, "x" * 255, "é"]


def test_paths_and_names(spark):
    assert [p for p in PATHS if validate.valid_path(p)] == ["a.txt", "dir/a.txt", "/abs/a", "x" * 4095, "..a", "a..", "a b~"]
    assert [p for p in NAMES if validate.valid_filename(p)] == ["a.txt", "CONSOLE", "x" * 254, "é"]
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert [r[0] for r in df.select(validate.valid_path_column(F.col("p"))).collect()] == [validate.valid_path(p) for p in PATHS]
    df = spark.createDataFrame([(p,) for p in NAMES], "p string")
    assert [r[0] for r in df.select(validate.valid_filename_column(F.col("p"))).collect()] == [validate.valid_filename(p) for p in NAMES]


def test_escapes(spark):
    text = 'q"b\\t\tn\nr\r'
    df = spark.createDataFrame([(text,), ("",), (None,)], "line string")
    got = df.select(formats.json_escaped(F.col("line")).alias("j"), formats.csv_quoted(F.col("line")).alias("c"), formats.json_line(F.col("line")).alias("o")).collect()
    assert json.loads(f'"{got[0]["j"]}"') == text
    assert got[0]["c"] == '"' + text.replace('"', '""').replace("\n", " ") + '"'
    assert json.loads(got[0]["o"]) == {"line": text}
    assert got[1]["c"] == '""' and got[2]["c"] is None


@given(st.lists(st.binary(max_size=70), max_size=30), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_murmur_on_arrays(keys, seed):
    a, b = hashing.murmur3_arrays(keys, seed)
    assert [(int(x), int(y)) for x, y in zip(a, b)] == [hashing.murmur3_128(k, seed) for k in keys]


@pytest.mark.parametrize("bits", [9585, 95_850_583, 2**40 + 15, 2**46 + 1])
def test_murmur_positions_as_expressions(spark, bits):
    keys = [f"key {i}" for i in range(40)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.Murmur3().positions(F.col("k"), 9, bits).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {k: hashing.murmur3_positions(k.encode(), 9, bits) for k in keys}
