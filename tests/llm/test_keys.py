"""Key filters, line history, heavy hitters and term counts against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesieve.llm import heavy_hitters as hh
from linesieve.llm import key_filter, keyed_table, wordsets
from linesieve.llm import history as history_module
from linesieve.llm.history import LineHistory
from linesieve.llm.peeling import PeelingFilter
from linesieve.llm.term_counts import term_statistics

ITEMS = "item_id bigint, batch_id int, src string, ord bigint, line string, cnt bigint, is_duplicate boolean, seen string, id string, batch string, _h string"


def table(spark, rows):
    """rows: (item_id, batch_id, src, ord, line, cnt); the further columns clash with names used inside."""
    return spark.createDataFrame([(*r, None, "x", "y", "z", "w") for r in rows], ITEMS)


def random_items(n=3000, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        u = rng.random()
        line = None if u < 0.02 else "" if u < 0.04 else "hot line" if u < 0.37 else f"line {rng.randint(0, 900)}"
        out.append((i + 1, i * 5 // n, f"s{i % 7}" if u < 0.98 else None, i, line, rng.choice([None, 1, 3])))
    again = [(n + k + 1, 4, *out[k * 13][2:]) for k in range(60)]  # second deliveries
    return out + again


@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 70_000])
def test_peeling_filter(bits, n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    f = PeelingFilter.build(np.r_[keys, keys], bits)
    assert f.n_keys == len(np.unique(keys)) and f.contains(keys).all()
    again = PeelingFilter.from_bytes(f.seed, f.segment, f.bits, f.n_keys, f.to_bytes())
    other = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert again.contains(other).mean() <= (1.3 * 2.0**-bits + 4e-5 if n else 0)


def seen_truth(rows, history=()):
    known, out = set(history), {}
    for item, _, _, _, line, _ in sorted(rows):
        if line is not None:
            out[item] = line in known
            known.add(line)
    return out


def test_seen_before(spark):
    rows = random_items()
    past = spark.createDataFrame([("line 1",), ("line 2",), (None,)], "line string")
    got = key_filter.seen_before(table(spark, rows), past, keys_per_bucket=100)
    assert {r["id"]: r["seen"] for r in got.collect()} == seen_truth(rows, {"line 1", "line 2"})
    got = key_filter.seen_before(table(spark, rows).repartition(7))
    assert {r["id"]: r["seen"] for r in got.collect()} == seen_truth(rows)


def test_seen_before_edges(spark):
    assert key_filter.seen_before(table(spark, [])).count() == 0
    rows = [(1, None, None, None, "a", None), (2, 1, "s", 1, "a", None), (None, 1, "s", 1, "b", None), (3, 1, "s", 2, None, None), (4, 2, "s", 3, "x" * 300_000, 1), (5, 2, "s", 4, "x" * 300_000, 1)]
    assert {r["id"]: r["seen"] for r in key_filter.seen_before(table(spark, rows)).collect()} == {1: False, 2: True, 4: False, 5: True}


def test_wrong_answers_are_reported(spark):
    rows = [(i + 1, i // 1000, "s", i, f"u{i}", 1) for i in range(8000)]
    r = key_filter.answer_rates(table(spark, rows).withColumn("is_duplicate", F.col("item_id") % 2 == 0), bits=8).orderBy("batch_id").collect()
    wrong = sum(x["wrong_seen"] for x in r)
    assert all(x["wrong_new"] == 0 for x in r) and wrong > 0
    assert all(x["n_new"] == 1000 and abs(x["measured_wrong_rate"] - x["wrong_seen"] / 1000) < 1e-12 for x in r)
    expected = sum(1000 * (1 - (1 - 2**-8) ** k) for k in range(8))
    assert abs(sum(x["expected_wrong_rate"] for x in r) * 1000 - expected) < 0.1 * expected
    assert 0.5 * expected < wrong < 1.6 * expected
    assert r[3]["recorded_wrong_seen"] == 500 and r[3]["recorded_unknown"] == 0


def test_expected_rate_is_compounded(spark):
    """Batch 1 repeats batch 0: it has no new key, hence no rate, and seals empty filters, which answer nothing wrongly."""
    rows = [(b * 1000 + k, b, "s", k, f"u{k if b < 2 else b * 1000 + k}", 1) for b in range(40) for k in range(100)]
    r = key_filter.answer_rates(table(spark, rows), bits=8, keys_per_bucket=10**6).orderBy("batch_id").collect()
    chance = lambda n: 1 - (1 - 2**-8) ** n
    assert [r[b]["expected_wrong_rate"] for b in (0, 2)] == pytest.approx([0, chance(1)])
    assert (r[1]["n_new"], r[1]["expected_wrong_rate"], r[1]["measured_wrong_rate"]) == (0, None, None)
    assert r[39]["expected_wrong_rate"] == pytest.approx(chance(38), rel=0.05)


def test_filter_store_equals_one_pass(spark, tmp_path):
    rows = random_items(1500)
    store = key_filter.FilterStore(str(tmp_path / "filters"), buckets=3)
    df, got = table(spark, rows), {}
    for b in range(5):
        got |= {r["id"]: r["seen"] for r in store.accept(df.where(F.col("batch_id") == b), b).collect()}
    assert got == seen_truth(rows)
    again = {r["id"]: r["seen"] for r in store.accept(df.where("batch_id = 4"), 4).collect()}  # repeated after a failure
    assert all(got[i] == s for i, s in again.items())


def near_truth(rows, past=()):
    """Exact definition: same line, or at least 8 words each and 7 in 10 shared, in an earlier batch."""
    sets, inverted, lines, cases = [], defaultdict(list), {x: -1 for x in past}, set()

    def add(line, b):
        s = wordsets.words(line)
        if len(s) >= 8:
            sets.append((s, b))
            for w in s:
                inverted[w].append(len(sets) - 1)

    for x in past:
        add(x, -1)
    reps = {}
    for item, b, _, _, line, _ in sorted(rows):
        if line is not None:
            reps.setdefault((b, line), item)
    for b in sorted({b for b, _ in reps}):
        mine = [(line, item) for (c, line), item in reps.items() if c == b]
        for line, item in mine:
            s, near = wordsets.words(line), False
            if len(s) >= 8:
                shared = Counter(k for w in s for k in inverted[w])
                near = any(n * 10 >= 7 * (len(s) + len(sets[k][0]) - n) for k, n in shared.items())
            if line in lines or near:
                cases.add(item)
        for line, _ in mine:
            lines.setdefault(line, b)
            add(line, b)
    return cases


def random_prose(n, seed=5, base=None):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, lines = [], base or []
    for i in range(n):
        u = rng.random()
        if lines and u < 0.3:
            w = rng.choice(lines).split(" ")
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            line = " ".join(w)
        elif u < 0.35:
            line = rng.choice(["", "short one", None, "éa b c d e f g h", "éA b-, c d e f g  h i"])
        else:
            line = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20)))
        if line:
            lines.append(line)
        rows.append((i + 1, i * 4 // n, "s", i, line, 1))
    return rows


@pytest.mark.parametrize("hot", [256, 2])
def test_near_repeats(spark, tmp_path, hot):
    """Also with a limit of 2 sets a bucket, which sends everything through the exact way for hot buckets."""
    rows = random_prose(1600)
    past = [r[4] for r in random_prose(100, 9) if r[4]] + ["éa b c d e f g h"]
    history = LineHistory(spark, str(tmp_path / "h"), hot=hot)
    history.ingest(spark.createDataFrame([(k, -5, x) for k, x in enumerate(past)], "item_id bigint, batch_id int, line string"), "past")
    got = {r["id"] for r in history.ingest(table(spark, rows), "all").where("exact or near").collect()}
    want = near_truth(rows, past)
    assert not got - want and len(want - got) <= 0.01 * len(want)


def test_near_repeats_batch_by_batch(spark, tmp_path):
    rows = random_prose(500, 11)
    a, b = LineHistory(spark, str(tmp_path / "a")), LineHistory(spark, str(tmp_path / "b"))
    whole = {r["id"] for r in a.ingest(table(spark, rows), "all").where("exact or near").collect()}
    parts = set()
    for k in range(4):
        parts |= {r["id"] for r in b.ingest(table(spark, rows).where(F.col("batch_id") == k), f"p{k}").where("exact or near").collect()}
    again = {r["id"] for r in b.ingest(table(spark, rows).where("batch_id = 3"), "p3").where("exact or near").collect()}
    assert parts == whole and again <= whole


def test_near_repeats_with_as_many_buckets_as_tasks(spark, tmp_path):
    """The tables' own clustering must not be taken for that of the rows which meet."""
    rows = random_prose(700, 17)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        history = LineHistory(spark, str(tmp_path / "h"), rows_per_bucket=2000)
        for b in range(4):
            history.accept(table(spark, rows).where(F.col("batch_id") == b), f"p{b}", batch=b)
            if b == 0:
                assert history.table.buckets == 12
        got = {r["id"] for r in history.verdicts([f"p{b}" for b in range(4)]).where("exact or near").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = near_truth(rows)
    assert not got - want and len(want - got) <= 0.01 * len(want)


def test_a_hot_family_of_different_near_copies(spark, tmp_path):
    """A third of all rows differ from one another in two words of twenty: nearly all share a bucket."""
    base = [f"b{i}" for i in range(20)]
    rng = random.Random(2)
    rows = [(i + 1, i % 6, "s", i, " ".join(base[:9] + [f"x{i}", f"y{rng.random()}"] + base[9:]) if i % 3 == 0 else " ".join(f"r{rng.randrange(10**6)}" for _ in range(12)), 1) for i in range(1500)]
    got = {r["id"] for r in LineHistory(spark, str(tmp_path / "f"), hot=16).ingest(table(spark, rows), "all").where("near").collect()}
    assert got == near_truth(rows)


def test_near_repeats_edges(spark, tmp_path):
    assert LineHistory(spark, str(tmp_path / "e")).ingest(table(spark, []), "x").count() == 0
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, 0, "s", 1, long, 1), (2, 1, "s", 2, long + " tail", 1), (3, 1, None, None, None, None), (4, None, "s", 3, "a b", 1), (5, 1, "s", 4, "a b", 1)]
    got = {r["id"]: (r["exact"], r["near"]) for r in LineHistory(spark, str(tmp_path / "l")).ingest(table(spark, rows), "x").collect()}
    assert got == {1: (False, False), 2: (False, True), 4: (False, False), 5: (True, False)}


def totals(rows):
    out, seen = Counter(), set()
    for item, _, src, o, line, cnt in rows:
        key = (src, o) if src is not None and o is not None else item
        if key not in seen:
            seen.add(key)
            if line is not None:
                out[line] += 1 if cnt is None else cnt
    return out


def test_heavy_hitters(spark):
    rows = random_items(4000)
    want = totals(rows)
    lone = F.when(F.col("src").isNull() | F.col("ord").isNull(), F.col("item_id"))
    df = table(spark, rows).withColumn("_lone", lone)
    got = hh.heavy_hitters(df, "line", "cnt", ["src", "ord", "_lone"], share=1 / 400, shape=hh.SketchShape(5, 1 << 12))
    grand = sum(want.values())
    assert {r["line"]: r["total"] for r in got.collect()} == {k: n for k, n in want.items() if n * 400 >= grand}
    top = got.orderBy(F.desc("total")).first()
    assert top["line"] == "hot line" and abs(top["estimate"] - top["total"]) < 0.05 * grand and top["grand_total"] == grand
    assert hh.heavy_hitters(df.where("false"), "line", "cnt", ["src", "ord", "_lone"], share=0.01).count() == 0


def test_term_statistics(spark):
    rows = random_items(1500)
    rows += [(9001, 4, "t", 1, "  a  b a b a ", 2), (9002, 4, "t", 2, "a b\tc", None), (9003, 4, "t", 3, "   ", 1), (9004, 4, "t", 4, "z " * 60_000, 1), (9005, 4, "t", 1, "  a  b a b a ", 2)]
    lines, seen = [], set()
    for item, _, src, o, line, cnt in rows:
        key = (src, o) if src is not None and o is not None else item
        if key not in seen:
            seen.add(key)
            lines.append((line, 1 if cnt is None else cnt))
    occ, rec = Counter(), Counter()
    for line, w in lines:
        t = [x for x in (line or "").split(" ") if x]
        grams = [" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        for g, c in Counter(grams).items():
            occ[g] += c * w
            rec[g] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # prefixes run on over batches
    try:
        for most in (1, 2, 3):
            got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_statistics(table(spark, rows), max_terms=most).collect()}
            want = {g: (occ[g], rec[g], "rare" if rec[g] < 3 else "common" if rec[g] > 0.01 * len(lines) else None) for g in occ if len(g.split(" ")) <= most}
            assert got == want
        assert term_statistics(table(spark, rows), max_terms=2, only=2).where("n_terms <> 2").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert term_statistics(table(spark, [])).count() == 0


def test_only_buckets_of_new_keys_are_read(spark, tmp_path):
    """Stored buckets that no new key falls in may be unreadable; with four times the history no more rows are read."""
    schema, read = "item_id bigint, batch_id int, line string", {}
    for n in (300, 1200):
        history = LineHistory(spark, str(tmp_path / f"h{n}"), rows_per_bucket=1000)
        past = [(k, 0, " ".join(f"w{k}x{j}" for j in range(10))) for k in range(n)]
        history.ingest(spark.createDataFrame(past, schema), "p0", batch=0)
        new = spark.createDataFrame([(10_000, 1, past[7][2] + " more")], schema)
        lines = history_module.line_sets(new.selectExpr("item_id as id", "cast(1 as bigint) as batch", "line")).selectExpr("h1", "h2", "batch", "id", "set_id", "cast(null as bigint) as since", "words")
        keys = lines.mapInArrow(history_module._entries(28, 5), history_module._KEYS).where("kind = 2").select("key")
        t = history.table
        assert t.n == n * 30
        used = {r[0] for r in keys.selectExpr(f"pmod(hash(key), {t.buckets})").collect()}
        files = list((tmp_path / f"h{n}" / "keys").rglob("*.parquet"))
        others = [f for f in files if int(f.name.split("_")[1].split(".")[0]) not in used]
        read[n] = sum(spark.read.parquet(str(f)).count() for f in set(files) - set(others))
        assert others
        kept = {f: f.read_bytes() for f in others}
        for f in others:
            f.write_bytes(b"unreadable")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        assert t.matching(keys, but="").count() >= 1
        for f, raw in kept.items():
            f.write_bytes(raw)
        assert [(r["id"], r["exact"], r["near"]) for r in history.ingest(new, "p1", batch=1).collect()] == [(10_000, False, True)]
    assert read[1200] < 2 * read[300] < 15_000


def test_tables_grow_merge_and_reopen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_table, "APPENDS", 3)
    t = keyed_table.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", "k", rows_per_bucket=50)
    assert t.rows().count() == 0
    for i in range(8):
        t.append(spark.range(i * 100, i * 100 + 100).selectExpr("id as k", "id * 2 as v"), f"p{i}")
        t.settle()
    again = keyed_table.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", "k", rows_per_bucket=50)
    assert (again.n, again.buckets) == (800, t.buckets) and t.buckets > 4 and len(list((tmp_path / "t").iterdir())) == 1
    for keys in (spark.range(150, 170), spark.range(150, 170 + keyed_table.FEW)):
        got = again.matching(keys.selectExpr("id as k"), but="p7")
        assert {r["k"] for r in got.collect()} == set(range(150, min(170 + (keys.count() > 20) * 1000, 700)))
    again.drop("p3")
    assert again.n == 700 and again.rows(only="p3").count() == 0


def test_history_after_a_failure_and_in_another_session(spark, tmp_path):
    rows = random_prose(600, 13)
    path = str(tmp_path / "h")
    first = LineHistory(spark, path)
    want = []
    for b in range(4):
        df = table(spark, rows).where(F.col("batch_id") == b)
        want.append({(r["id"], r["exact"], r["near"]) for r in first.ingest(df, f"p{b}", batch=b).collect()})
        if b == 2:  # the call is repeated, by a history that is opened anew
            first = LineHistory(spark, path)
            assert {(r["id"], r["exact"], r["near"]) for r in first.ingest(df, f"p{b}", batch=b).collect()} == want[-1]
    cases = {i for part in want for i, exact, near in part if exact or near}
    truth = near_truth(rows)
    assert not cases - truth and len(truth - cases) <= 0.01 * len(truth)


def test_frequent_band_keys_are_split_from_the_others():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = np.where(rng.random(300_000) < 0.01, 7, rng.integers(0, 2**62, 300_000))
    got = list(history_module._frequent(256)(iter([pa.RecordBatch.from_arrays([pa.array(x)], names=["band"]) for x in np.array_split(rows, 31)])))
    assert [b["band"].to_pylist() for b in got] == [[7]]


def test_stored_sets_are_not_paired_again():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array([10, 11, 12, 13]), pa.array([0, 1, 2, 3])], names=["band", "set_id", "first"])
    for hot in (256, 2):
        got = [p for b in history_module._meet(hot, 3)(iter([rows])) for p in zip(b["set_id"].to_pylist(), b["other"].to_pylist()) if p[1] is not None]
        assert got and {a for a, _ in got} == {13}


def test_band_keys_meet_without_a_step_each():
    """A quarter of a million band keys of two or three sets, cut into batches anywhere: pairs as by brute force, and fast."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = np.sort(rng.integers(0, 250_000, 600_000)), rng.integers(0, 2**62, 600_000), np.zeros(600_000, np.int64)
    firsts = rng.integers(0, 4, 600_000)
    order = np.lexsort((firsts, rows[0]))
    t = pa.RecordBatch.from_arrays([pa.array(rows[0][order]), pa.array(rows[1][order]), pa.array(firsts[order])], names=["band", "set_id", "first"])
    began = time.perf_counter()
    got = [b for b in history_module._meet(256, 3)(iter([t.slice(k, 9_973) for k in range(0, t.num_rows, 9_973)]))]
    took = time.perf_counter() - began
    members, want = defaultdict(list), set()
    for band, i, f in zip(*(t.column(k).to_pylist() for k in range(3))):
        members[band].append((i, f))
    for found in members.values():
        want |= {(a, b) for a, fa in found if fa >= 3 for b, fb in found if fb < fa}
    assert {p for b in got for p in zip(b["set_id"].to_pylist(), b["other"].to_pylist())} == want
    assert took < 3  # seconds; one step of the interpreter a band key took 10


def test_buckets_are_those_of_spark(spark):
    keys = [0, -1, 1, 2**63 - 1, -(2**63), *np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 200).tolist()]
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for n in (1, 12, 600):
        want = [r[0] for r in df.selectExpr(f"pmod(hash(key), {n})").collect()]
        assert keyed_table.buckets_of(np.array(keys), n).tolist() == want


def test_a_large_batch_is_written_once_into_buckets(spark, tmp_path):
    """The buckets are made before the first rows of a batch that will fill them come, not by writing them again."""
    history = LineHistory(spark, str(tmp_path / "h"), rows_per_bucket=1000)
    rows = random_prose(700, 19)
    for b in range(2):
        history.accept(table(spark, rows).where(F.col("batch_id") == b), f"p{b}", batch=b)
    (folder,) = (tmp_path / "h" / "keys").iterdir()
    assert folder.name.startswith("000000-") and history.table.buckets >= 4
    assert history.table.n == history.table.rows().count() == history.table.rows(only="p0").count() + history.table.rows(only="p1").count()
    assert len(list(folder.glob("*.parquet"))) <= 2 * history.table.buckets


def test_items_are_read_once_for_all_batches(spark, monkeypatch):
    from linesieve.llm import queries

    rows, read = random_prose(600, 23), spark.sparkContext.accumulator(0)
    rows += [(1000 + k, None, "s", k, r[4], 1) for k, r in enumerate(rows[:30])]  # the batch without a number comes first

    def seen(r):
        read.add(1)
        return r

    items = spark.createDataFrame(spark.sparkContext.parallelize([(r[0], r[1], r[4]) for r in rows], 3).map(seen), "item_id bigint, batch_id int, line string")
    past = spark.createDataFrame([(1, rows[3][4]), (2, "of nobody")], "line_id bigint, line string")
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: items if name == "work_item_t" else past)
    got = {r["item_id"] for r in queries.p4_found(spark, "").collect()}
    want = near_truth([(i, -1 if b is None else b, s, o, line, c) for i, b, s, o, line, c in rows], [rows[3][4], "of nobody"])
    assert not got - want and len(want - got) <= 0.01 * len(want)
    assert read.value == len(rows)
