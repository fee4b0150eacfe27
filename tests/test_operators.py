"""Operators against sequential simulations that follow the definitions line by line."""

import random

import pytest
from pyspark.sql import functions as F

from linesieve.functions.hashing import Md5, Murmur3, XxHash
from linesieve.functions.sizing import BloomParams, bloom_params, level_error, scaling_params
from linesieve.operators import bloom, counting, exact, model, scaling, stats

WORDS = [f"word{i}" for i in range(400)]


def some_lines(spark, n=1500, words=WORDS, seed=1, hot=0.33):
    rng = random.Random(seed)
    data = [(i + 1, "hot" if rng.random() < hot else rng.choice(words)) for i in range(n)]
    data[10] = (11, None)
    data[20] = (21, None)
    data[30] = (31, "")
    return data, spark.createDataFrame(data, "ord bigint, line string").withColumn("extra", F.lit(1))


def positions_of(spark, family, params, keys):
    keys = list(dict.fromkeys(keys))
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    if hasattr(params, "per_hash"):
        at = counting._positions(family, F.col("k"), params)
    else:
        at = family.positions(F.col("k"), params.hashes, params.bits)
    return {r["k"]: r["p"] for r in df.select("k", at.alias("p")).collect()}


def test_exact_operators(spark):
    data, df = some_lines(spark)
    first, count = {}, {}
    for o, line in data:
        first.setdefault(line, o)
        count[line] = count.get(line, 0) + 1
    assert {(r["line"], r["ord"]) for r in exact.first_occurrences(df, "line", "ord").collect()} == set(first.items())
    assert {r["ord"] for r in exact.repeats(df, "line", "ord").collect()} == {o for o, line in data} - set(first.values())
    assert exact.unique_rows(df, "line", "ord").columns == ["ord", "line", "extra"]
    assert {r["ord"] for r in exact.unique_rows(df, "line", "ord").collect()} == set(first.values())
    assert {(r["line"], r["cnt"]) for r in exact.counts(df, "line", "ord").collect()} == set(count.items())
    assert {r["line"] for r in exact.repeated_keys(df, "line", "ord").collect()} == {k for k, n in count.items() if n > 1}
    assert {r["line"] for r in exact.single_keys(df, "line", "ord").collect()} == {k for k, n in count.items() if n == 1}
    assert exact.top_repeated(df, "line", "ord", 1).first()["line"] == "hot"
    known = spark.createDataFrame([("hot",), (None,)], "line string")
    assert {r["line"] for r in exact.new_rows(df, known, "line", "ord").collect()} == set(first) - {"hot", None}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "ord bigint, line string")
    p = bloom_params(1000, 0.01)
    for got in (exact.first_occurrences(df, "line", "ord"), exact.repeats(df, "line", "ord"), bloom.unique(df, "line", "ord", p), bloom.build(df, "line", "ord", p), counting.prior_counts(df, "line", "ord", p), counting.counters(df, "line", p), scaling.scaling_unique(df, "line", "ord", 1000, 0.1).accepted):
        assert got.count() == 0
    assert stats.line_statistics(df, "line").first().asDict() == {"total_lines": 0, "unique_lines": 0, "duplicate_lines": 0}
    assert bloom.measured_error(df, "line", "ord", p).first()["lost_lines"] == 0


@pytest.mark.parametrize("family", [XxHash(), Md5(), Murmur3()], ids=lambda f: f.name)
@pytest.mark.parametrize("params", [bloom_params(1000, 0.01), bloom_params(1000, 0.5), BloomParams(0, 0.1, 300, 0, 0, 3)], ids=["usual", "weak", "tiny"])
def test_bloom_is_the_sequential_filter(spark, family, params):
    data, df = some_lines(spark)
    at = positions_of(spark, family, params, [x for _, x in data])
    bits, emitted = set(), []
    for o, line in data:
        if any(p not in bits for p in at[line]):
            emitted.append(o)
        bits.update(at[line])
    got = sorted(r["ord"] for r in bloom.unique(df, "line", "ord", params, family).collect())
    assert got == emitted
    assert {r["pos"] for r in bloom.build(df, "line", "ord", params, family).collect()} == bits


@pytest.mark.parametrize("error", [0.5, 0.1, 0.01])
def test_bloom_properties(spark, error):
    data, df = some_lines(spark, 3000, [f"w{i}" for i in range(950)])
    distinct = {x for _, x in data}
    got = bloom.unique(df, "line", "ord", bloom_params(1000, error)).collect()
    assert len({r["line"] for r in got}) == len(got)  # no line twice
    first = {}
    for o, x in data:
        first.setdefault(x, o)
    assert all(first[r["line"]] == r["ord"] for r in got)
    assert (len(distinct) - len(got)) / len(distinct) <= 2 * error


def test_bloom_does_not_depend_on_partitions(spark):
    _, df = some_lines(spark)
    p = BloomParams(0, 0.1, 900, 0, 0, 3)
    want = None
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = sorted(r["ord"] for r in bloom.unique(df.repartition(n), "line", "ord", p).collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overfull_filter_loses_lines(spark):
    df = spark.range(20_000).select((F.col("id") + 1).alias("ord"), F.col("id").cast("string").alias("line"))
    assert bloom.unique(df, "line", "ord", bloom_params(1000, 0.01)).count() < 10_000


def test_probe(spark):
    data, df = some_lines(spark)
    p = bloom_params(1000, 0.01)
    other = next(x for _, x in data if x not in ("hot", "", None))
    a = spark.createDataFrame([("hot",), (other,), (None,)], "line string").withColumn("ord", F.monotonically_increasing_id())
    m = bloom.build(a, "line", "ord", p)
    hit = {r["line"] for r in bloom.semi(df, "line", m, p).collect()}
    miss = {r["line"] for r in bloom.anti(df, "line", m, p).collect()}
    assert {"hot", other, None} <= hit and not hit & miss and len(hit) < 12
    assert bloom.semi(df, "line", m, p).count() + bloom.anti(df, "line", m, p).count() == df.count()


def test_partitioned(spark):
    data, df = some_lines(spark)
    got = bloom.partitioned_unique(df, "line", "ord", bloom_params(1000, 0.001), 8)
    assert got.count() >= len({x for _, x in data}) - 2


@pytest.mark.parametrize("params", [bloom_params(1000, 0.1), BloomParams(0, 0.1, 300, 0, 0, 3)], ids=["usual", "tiny"])
def test_counting_is_the_sequential_filter(spark, params):
    data, df = some_lines(spark, 1200)
    at = {k: set(v) for k, v in positions_of(spark, Md5(), params, [x for _, x in data]).items()}
    n, prior = {}, {}
    for o, x in data:
        prior[o] = min(min(n.get(p, 0) for p in at[x]), 15)
        for p in at[x]:
            n[p] = n.get(p, 0) + 1
    got = {r["ord"]: r["prior"] for r in counting.prior_counts(df, "line", "ord", params, Md5()).collect()}
    assert got == prior
    c = counting.counters(df, "line", params, Md5())
    assert {r["pos"]: r["n"] for r in c.collect()} == n
    est = {r["line"]: r["estimate"] for r in counting.estimates(df, "line", c, params, Md5()).collect()}
    count = {}
    for _, x in data:
        count[x] = count.get(x, 0) + 1
    assert est == {x: min(min(n[p] for p in at[x]), 15) for x in count}
    assert all(est[x] >= min(count[x], 15) for x in count)
    s = counting.insertion_statistics(counting.prior_counts(df, "line", "ord", params, Md5())).first()
    assert (s[0], s[1]) == (len(data), sum(p == 0 for p in prior.values()))


def test_remove_restores(spark):
    _, df = some_lines(spark, 300)
    p = scaling_params(1000, 0.05)
    before = counting.counters(df, "line", p)
    more = spark.createDataFrame([("new",), ("hot",)], "line string")
    after = counting.merged(before, counting.counters(more, "line", p), counting.counters(more, "line", p, sign=-1))
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect()}
    assert counting.contains(more, "line", after, p).count() == 1


@pytest.mark.parametrize("error", [0.5, 0.1, 0.01])
def test_scaling_is_the_sequential_filter(spark, error):
    rng = random.Random(1)
    data = [(i + 1, f"w{rng.randint(0, 3000)}") for i in range(6000)]
    df = spark.createDataFrame(data, "ord bigint, line string")
    fam, capacity = XxHash(), 1000
    got = scaling.scaling_unique(df, "line", "ord", capacity, error, fam)
    subs, accepted = [], []
    for level in range(8):
        subs.append(positions_of(spark, fam, scaling_params(capacity, level_error(error, level)), [x for _, x in data]))
    bits = [set()]
    count = 0
    for o, x in data:
        if any(all(p in bits[k] for p in subs[k][x]) for k in range(len(bits))):
            continue
        if count == capacity - 1:
            bits.append(set())
            count = 0
        bits[-1].update(subs[len(bits) - 1][x])
        count += 1
        accepted.append((o, len(bits) - 1))
    assert sorted((r["ord"], r["level"]) for r in got.accepted.collect()) == accepted
    assert len(got.levels) == len(bits)
    assert scaling.scaling_hits(df, "line", got.model, got.levels, fam).count() == df.select("line").distinct().count()
    assert scaling.owning_level(got.levels, 1) == 0 and scaling.owning_level(got.levels, accepted[-1][0]) == len(bits) - 1
    counts = scaling.scaling_counters(got.accepted, "line", got.levels, fam)
    left = scaling.scaling_remove(counts, got.accepted.select("line", "ord"), "line", "ord", got.levels, fam)
    assert left.count() == 0


def test_scaling_gives_up(spark):
    df = spark.range(5000).select((F.col("id") + 1).alias("ord"), F.col("id").cast("string").alias("line"))
    with pytest.raises(ValueError):
        scaling.scaling_unique(df, "line", "ord", 1000, 0.1, most_levels=2)


def test_model_round_trip(spark, tmp_path):
    data, df = some_lines(spark)
    p = bloom_params(1000, 0.01)
    path = str(tmp_path / "m")
    model.save(bloom.build(df, "line", "ord", p), path, p, max_id=1500)
    probe = df.unionByName(spark.createDataFrame([(9001, "fresh", 1)], "ord bigint, line string, extra int"))
    assert {r["line"] for r in model.incremental_unique(probe, "line", "ord", path).collect()} == {"fresh"}
    model.extend(spark.createDataFrame([(9001, "fresh")], "ord bigint, line string"), "line", "ord", path, 9001)
    assert model.incremental_unique(probe, "line", "ord", path).count() == 0
    m = model.load(spark, path, 1000, 0.01, "xxhash64")
    assert (m.max_id, m.seqnum) == (9001, 2)
    for bad in ({"entries": 2000}, {"error": 0.1}, {"family": "md5"}):
        with pytest.raises(ValueError):
            model.load(spark, path, **bad)
    with pytest.raises(FileNotFoundError):
        model.load(spark, str(tmp_path / "none"))
    model._write_meta(spark, path, ("fixed", 1000, 0.01, p.bits, p.hashes, "xxhash64", 0, 3, 0))
    with pytest.raises(ValueError):
        model.load(spark, path)


def test_scaling_and_counting_models_round_trip(spark, tmp_path):
    df = spark.range(2500).select((F.col("id") + 1).alias("ord"), F.col("id").cast("string").alias("line"))
    got = scaling.scaling_unique(df, "line", "ord", 1000, 0.01)
    path = str(tmp_path / "s")
    model.save_scaling(got, path, max_id=2500)
    bits, levels = model.load_scaling(spark, path, 1000, 0.01)
    assert levels == got.levels and bits.count() == got.model.count()
    assert scaling.scaling_hits(df, "line", bits, levels).count() == 2500
    with pytest.raises(ValueError):
        model.load_scaling(spark, path, 1000, 0.02)
    p = bloom_params(1000, 0.01)
    c = counting.counters(df, "line", p)
    model.save_counters(c, str(tmp_path / "c"), p)
    assert {tuple(r) for r in model.load(spark, str(tmp_path / "c"), 1000, 0.01).positions.collect()} == {tuple(r) for r in c.collect()}


def test_statistics(spark):
    data, df = some_lines(spark)
    s = stats.finished(stats.line_statistics(df, "line"), 2.0, 0.01).first()
    assert (s["total_lines"], s["unique_lines"]) == (len(data), len({x for _, x in data}))
    assert s["throughput"] == len(data) / 2 and s["false_positive_rate"] == 0.01
    seen, o = stats.observed(df, F.col("line") == "hot")
    seen.count()
    assert o.get["total_lines"] == len(data) and o.get["unique_lines"] == sum(x == "hot" for _, x in data)
    assert stats.progress(0, 10, 1.0)[0] == 0 and stats.progress(5, 10, 2.0) == (50.0, 2.0) and stats.progress(0, 0, 1.0) == (100.0, 0.0)
