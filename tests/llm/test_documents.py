"""Packing, mixing, encoding repair and scoring of abusive content."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from linesieve.llm import encoding, mixing, packing, toxicity
from linesieve.llm.toxic_seeds import IDENTITY
from linesieve.llm.tokens import TOKENIZER_PATH, with_sizes

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER_PATH), reason="no tokenizer files here")


# sizes -------------------------------------------------------------------


@needs_tokenizer
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> é 世界"), (5, "a " * 50_000)], "doc_id bigint, text string").selectExpr("*", "'x' as n_tokens")
    got = {r["id"]: r["n_tokens"] for r in with_sizes(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 7 and 50_000 <= got[5] <= 100_001


# packing -----------------------------------------------------------------


def _placed(plan, lengths):
    """Container of every piece by the plan; lengths sorted within classes."""
    cls = plan.size_class(lengths)
    order = np.lexsort((lengths, cls))
    lengths, cls = lengths[order], cls[order]
    start = np.r_[0, np.flatnonzero(np.diff(cls)) + 1]
    rank = np.arange(len(cls)) - np.repeat(start, np.diff(np.r_[start, len(cls)]))
    rows = np.array(sorted(plan.rows))
    at = np.searchsorted((rows[:, 0] << 40) | rows[:, 1], (cls << 40) | rank, side="right") - 1
    assert (rows[at, 0] == cls).all() and (rank < rows[at, 2]).all()
    return rows[at, 3] + (rank - rows[at, 1]) // rows[at, 4], lengths


@given(st.sampled_from([7, 100, 512, 2048, 5000]), st.lists(st.integers(1, 5000), max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_piece_once_and_fit(capacity, sizes, copies):
    lengths = np.array([s for s in sizes if s <= capacity] * copies, np.int64)
    plan = packing.make_plan(capacity, *np.unique(lengths, return_counts=True))
    if not len(lengths):
        assert plan.containers == 0
        return
    where, lengths = _placed(plan, lengths)
    fill = np.bincount(where, lengths, plan.containers)
    assert fill.max() <= capacity and fill.min() > 0 and fill.sum() == lengths.sum()


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_little_space_is_unused(capacity):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.3, 1.0, 20_000).astype(int) + 1, capacity)
    plan = packing.make_plan(capacity, *np.unique(lengths, return_counts=True))
    assert plan.by_pattern > 0
    assert lengths.sum() / (plan.containers * capacity) > 0.99


def test_least_squares_is_exact_where_it_can_be():
    sizes, repeats = packing.enumerate_patterns(np.array([2, 3, 5, 6]), 10)
    assert all((s * m).sum() == 10 for s, m in zip(sizes, repeats)) and len(sizes) >= 3
    target = np.zeros(11)
    target[[2, 3, 5]] = [100, 0, 100]  # 5+5, 5+3+2, 2x... fill exactly
    x = packing.nnls(sizes, repeats, target, 3000)
    left = target - np.bincount(sizes.ravel(), (repeats * x[:, None] * (sizes > 0)).ravel(), 11)
    assert (x >= 0).all() and abs(left[5]) < 5


def test_pack(spark):
    rng = random.Random(4)
    data = [(i, 300 if i % 3 == 0 else rng.randint(1, 1500)) for i in range(900)] + [(1000, 0), (1001, None), (None, 7), (1002, 512), (1003, 1024), (1004, 100_000)]
    sizes = spark.createDataFrame([(*r, "x") for r in data], "id bigint, n_tokens bigint, kind string")
    kinds = spark.createDataFrame([("a", 512), ("b", 2048), ("b", 2048), ("bad", 0), ("none", None), (None, 10)], "container_kind string, capacity_tokens int")
    got = packing.pack(sizes, kinds).cache()
    for kind, cap in (("a", 512), ("b", 2048)):
        rows = got.where(f"container_kind = '{kind}'").collect()
        fill, parts = Counter(), defaultdict(list)
        for r in rows:
            fill[r["container_id"]] += r["n_tokens"]
            parts[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
        assert max(fill.values()) <= cap
        want = {i: n for i, n in data if i is not None and n}
        assert {i: sum(p[2] for p in ps) for i, ps in parts.items()} == want
        for i, ps in parts.items():
            assert len(ps) == -(-want[i] // cap)  # split only as often as needed
            assert [p[1] for p in sorted(ps)] == [k * cap for k in range(len(ps))]
    u = {r["container_kind"]: r for r in packing.unused(got, kinds).collect()}
    assert set(u) == {"a", "b"} and all(0 <= r["unused_share"] < 0.25 and r["n_containers"] >= r["least_containers"] for r in u.values())
    assert packing.pack(sizes.where("false"), kinds).count() == 0
    assert packing.pack(sizes, kinds.where("false")).count() == 0


# mixing ------------------------------------------------------------------


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=400), st.floats(0.01, 0.99), st.integers(0, 9))
@settings(max_examples=80, deadline=None)
def test_flight_keeps_both_totals(tokens, p, seed):
    t = np.array(tokens)
    q = mixing.fly(t, np.full(len(t), p), seed)
    assert ((q >= 0) & (q <= 1)).all() and ((q > 0) & (q < 1)).sum() <= 2
    assert abs((t * q).sum() - p * t.sum()) < 1e-5 * t.sum() and abs(q.sum() - p * len(t)) < 1e-5 * len(t)
    r = mixing.land(t, q)
    assert set(np.unique(r)) <= {0.0, 1.0}
    assert abs((t * r).sum() - p * t.sum()) <= t.max()


def test_flight_is_fair():
    t = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 3)
    mean = np.mean([mixing.fly(t, np.full(24, 0.3), s) for s in range(800)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.001 and mean.min() > 0.23 and mean.max() < 0.37


def test_rates():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1)}
    r = mixing.rates({"a": 1000.0, "b": 100.0}, targets)
    assert r["b"] == 2.0 and abs(1000 * r["a"] / (100 * r["b"]) - 5 / 3) < 1e-9
    r = mixing.rates({"a": 1000.0, "b": 100.0}, targets, total=1e6)
    assert r == {"a": 1.0, "b": 2.0}
    have = {"a": 1000.0, "b": 10.0}
    used = [sum(have[s] * x for s, x in mixing.rates(have, targets, tolerance=t).items()) for t in (0.0, 0.01, 0.05, 1.0)]
    assert used == sorted(used) and used[0] < 0.06 * 1000 and used[-1] == 1000 + 20
    r = mixing.rates(have, targets, tolerance=0.05)
    assert r["b"] == 2.0 and 0.045 < mixing.deviation(have, targets, r) <= 0.05
    assert mixing.rates({}, targets) == {} and mixing.rates({"a": 5.0}, {}) == {}


@pytest.mark.parametrize("block", [50_000, 40])
def test_mix(spark, block):
    rng = random.Random(6)
    data = [(i, rng.choice([" Big-One", "big_one", "BIG ONE"]), rng.randint(1, 400)) for i in range(1500)]
    data += [(5000 + i, "small", rng.randint(1, 400)) for i in range(100)] + [(9000, None, 5), (9001, "other", 5), (9002, "small", 0), (9003, "small", None), (None, "small", 3)]
    sizes = spark.createDataFrame([(*r, 0) for r in data], "id bigint, source string, n_tokens bigint, p int")
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(sizes, targets, block=block).cache()
    rows = got.collect()
    assert len(rows) == len({r["id"] for r in rows}) == len(data) - 1
    assert all(r["repeats"] == 0 for r in rows if r["source"] in (None, "other") or not r["n_tokens"])
    assert max(r["repeats"] for r in rows if r["source"] == "small") <= 3 and max(r["repeats"] for r in rows if r["source"] == "big_one") <= 1
    s = {r["source"]: r for r in mixing.shares(got, targets.where("source is not null")).collect()}
    assert abs(s["big_one"]["actual_share"] - 2 / 3) < 0.005 and abs(s["small"]["actual_share"] - 1 / 3) < 0.005
    assert s["absent"]["actual_share"] == 0 and s["absent"]["tokens"] == 0
    assert {r["id"]: r["repeats"] for r in mixing.mix(sizes.repartition(5), targets, block=block).collect()} == {r["id"]: r["repeats"] for r in rows}
    loose = {r["source"]: r for r in mixing.shares(mixing.mix(sizes, targets, tolerance=0.1, block=block), targets.where("source is not null")).collect()}
    assert loose["small"]["tokens"] >= s["small"]["tokens"] and loose["big_one"]["tokens"] > s["big_one"]["tokens"] and loose["small"]["most_repeats"] == 3
    t = mixing.tradeoff(sizes, targets, (0.0, 0.1, 1.0)).orderBy("tolerance").collect()
    assert t[0]["tokens"] < t[1]["tokens"] <= t[2]["tokens"] and t[0]["deviation"] < 1e-6 and t[1]["deviation"] <= 0.1
    assert mixing.tradeoff(sizes.where("false"), targets, (0.0,)).count() == 0
    assert mixing.mix(sizes.where("false"), targets).count() == 0
    assert mixing.mix(sizes, targets.where("false")).where("repeats > 0").count() == 0


# encodings ---------------------------------------------------------------

GARBLED = [
    ("café naïve", "utf-8", "cp1252"), ("don’t “shut”", "utf-8", "mac_roman"), ("grüße", "utf-8", "cp437"), ("größer", "utf-8", "cp850"),
    ("привет мост", "utf-8", "cp1251"), ("работа", "utf-8", "koi8_r"), ("город", "utf-8", "latin-1"), ("город", "cp1251", "latin-1"),
    ("přítel květina", "utf-8", "cp1250"), ("图书馆 学生", "utf-8", "latin-1"), ("图书馆 学生", "gbk", "latin-1"), ("도시 작은다리", "euc_kr", "latin-1"),
    ("こんにちは", "shift_jis", "latin-1"), ("21 °C", "utf-8", "cp1252"), ("été théâtre", "latin-1", "cp1251"), ("€20", "utf-8", "cp850"), ("người tiếng", "utf-8", "latin-1"),
]

NATURAL = [
    "", "plain", "ÆRØ–Xy", "‘a’ … “a”", "¿Qué? ¡sí!", "«mot»", "10 µm 25 °C ±½", "AÇÃO ESTAÇÃO", "Ñ: ÞAÐ", "Ä Ö Ü", "├── x", "╔═ x ═╗", "№ 5 → ✓ ☕", "привет ДЁН ЭТО", "καλημέρα ΦΩΣ",
    "图书馆 你好", "こんにちは 雨の音", "도서관", "ŒUVRE cœur", "người phố", "gla﻿cier re​ad", "Ｒｉｂｂｏｎ", "été", "x\x00y é", "™ ¶ 3", "año mañana", "№", "🙂",
]


@pytest.mark.parametrize("text,written,read", GARBLED)
def test_garbled_text_is_found_and_restored(text, written, read):
    bad = text.encode(written).decode(read)
    state, got, _ = encoding.Repairer().line(f"word {bad} more")
    assert state == 1
    if written not in ("gbk", "euc_kr"):  # these share their byte pairs: which of them it was, the corpus decides
        assert got == f"word {text} more"


@pytest.mark.parametrize("text", NATURAL)
def test_natural_text_is_left_alone(text):
    assert encoding.Repairer().line(text)[:2] == (0, text)


def test_twice_garbled_and_lost():
    r = encoding.Repairer()
    assert r.line("é".encode().decode("cp1252").encode().decode("cp1252") + "t" + "é".encode().decode("cp1252").encode().decode("cp1252"))[:2] == (1, "été")
    assert r.line("h�r tr�d")[0] == 2
    assert r.line("IRMÃ€".lower())[0] == 1  # case changed after the garbling


@given(st.text(alphabet="abcdefgh éèüñçß", min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_round_trip(text):
    assume(not re.search("[éèüñçß]{4}", text))  # no language has four such letters in a row
    r = encoding.Repairer()
    assert r.line(text)[:2] == (0, text)
    bad = text.encode().decode("latin-1")
    if bad != text:
        assert r.line(bad)[:2] == (1, text)


def test_only_well_formed_spans_are_decoded():
    assert encoding.utf8_spans("Ã©Ã", "cp1252") == "éÃ"
    assert encoding.utf8_spans("plain é", "cp1252") is None
    assert encoding.utf8_spans("\xc0\xaf", "latin-1") is None  # overlong


def test_corpus_evidence(spark):
    rows = [(i, "město leží u řeky") for i in range(30)] + [(100, "mìsto leží"), (101, None), (102, ""), (103, "mìlo"), (104, "cafÃ© " * 3000), (104, "cafÃ© " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, line string, state string")
    got = {r["id"]: (r["state"], r["restored"]) for r in encoding.repaired(df.where("item_id <> 104")).collect()}
    assert got == {100: (1, "město leží")}
    assert sorted(r["id"] for r in encoding.garbled(df).collect()) == [100, 104, 104]
    assert encoding.garbled(df.where("false")).count() == 0


def test_hot_garbled_line_and_garbled_fields(spark):
    right = [(i, f"město číslo {i}") for i in range(12)]
    hot = [(100 + i, "mìsto") for i in range(30)]
    inner = [(200, "7;mìsto;x"), (201, "/" + "a" * 70 + "/mìsto,b"), (202, "7;město;x")]
    df = spark.createDataFrame(right + hot + inner, "item_id bigint, line string")
    got = {r["id"]: r["restored"] for r in encoding.repaired(df).collect()}
    assert got == {**{i: "město" for i, _ in hot}, 200: "7;město;x", 201: "/" + "a" * 70 + "/město,b"}


# abusive content ---------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([])


def test_seed_model_separates(model):
    bad = ["You are a stupid idiot!", "GO KILL YOURSELF, LOSER", "Foo ist ein dummes Arschloch", "ta gueule, connard", "the women there are all sluts", "fuck you all"]
    good = ["The river is 12 km long.", "In the play, the miller calls him a stupid fool.", "Infected larvae die.", "To stop the program, kill the child process.", "The word idiot meant a private person.", "This damn page is hard to read"]
    assert min(map(model.score, bad)) > max(map(model.score, good))
    assert all(model.score(x) == 0.0 for x in (None, "", "   "))


@pytest.mark.parametrize("form", ["yoouuu aaare a stuuupid idiooot", "y-o-u are a s.t.u.p.i.d i d i o t", "yоu аrе а stuрid idiоt", "ｙｏｕ are a ｓｔｕｐｉｄ ｉｄｉｏｔ", "you are a st​upid idi​ot", "you are a $tup1d 1d10t", "you are a st*pid id#ot", "you are a stpuid iidot"])
def test_disguises(model, form):
    plain = model.vocabulary.numbers(toxicity.fold("you are a stupid idiot"))
    got = model.vocabulary.numbers(toxicity.fold(form))
    assert set(plain[-2:]) <= set(got)


def test_worst_segment_counts_anywhere(model):
    calm = "The town has a market hall. " * 2000
    assert model.score(calm + "\n|| you are a stupid idiot ||\n" + calm) == pytest.approx(model.score("you are a stupid idiot"), rel=1e-6)
    assert model.score(calm) < 0.5


@pytest.mark.parametrize("form", ['<span title="you are a stupid idiot">', "<span class='a' title='you are a stupid idiot' id='b'/>", "<you are a stupid idiot>", "<!-- you are a stupid idiot -->", "a < b <b>you are a stupid idiot</b>"])
def test_text_in_tags_and_comments_is_scored(model, form):
    assert model.score(f"The town has a hall {form} and a market.") == pytest.approx(model.score("you are a stupid idiot"), rel=1e-6)


def test_identity_swaps_in_documents_are_whole(monkeypatch):
    seen = []
    whole = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda rows, y, weight, pairs, **k: seen.append(len(pairs)) or whole(rows, y, weight, pairs, **(k | {"rounds": 1})))
    toxicity.fit([])
    for line, more in (("die männer wohnten hier", 1), ("the manner of it", 0), ("les étrangers et les juifs", 2), ("os muçulmanos", 1), ("the jews " + "held a market and " * 30, 1)):
        toxicity.fit([(line, 0.0)], rounds=0)
        assert seen[-1] - seen[0] == more, line
    toxicity.fit([("\n".join(f"the jews of town {i}" for i in range(20_100)), 0.0)], rounds=0)
    assert seen[-1] - seen[0] == 20_100


SCRIPTS = {
    "zh": (["你是个愚蠢的白痴", "他们都是愚蠢的白痴。"], ["这条河长十二公里", "市场在城镇的中心", "这座桥建于十九世纪"], "你们这些愚蠢的白痴"),
    "ja": (["お前は馬鹿な奴だ", "馬鹿な奴らだ。"], ["川の長さは十二キロです", "市場は町の中心にあります", "橋は古いです"], "あの馬鹿な奴"),
    "th": (["คุณเป็นคนโง่เง่า", "พวกโง่เง่าทั้งหมด"], ["แม่น้ำยาวสิบสองกิโลเมตร", "ตลาดอยู่กลางเมือง", "สะพานเก่า"], "เขาโง่เง่ามาก"),
    "ar": (["أنت غبي حقير", "يا غبي حقير؟"], ["النهر طويل جدا", "السوق في وسط المدينة", "بني الجسر في القرن التاسع"], "هذا غبي حقير"),
    "he": (["אתה טיפש מטומטם", "כולם טיפש מטומטם"], ["הנהר ארוך מאוד", "השוק במרכז העיר", "הגשר ישן"], "הוא טיפש מטומטם"),
    "hi": (["तुम मूर्ख कमीने हो", "सब मूर्ख कमीने हैं।"], ["नदी बारह किलोमीटर लंबी है", "बाजार शहर के बीच में है", "पुल पुराना है"], "ये मूर्ख कमीने"),
    "ko": (["너는 멍청한 바보", "모두 멍청한 바보"], ["강은 아주 길다", "시장은 도시 가운데 있다", "다리는 오래되었다"], "그는 멍청한 바보"),
}


@pytest.mark.parametrize("lang", SCRIPTS)
def test_scripts_without_case_are_learned(lang):
    bad, good, new = SCRIPTS[lang]
    m = toxicity.fit([("\n".join(good[i % 3 :] + [bad[i % 2]] * (i % 4 == 0) + good[: i % 3]), float(i % 4 == 0)) for i in range(40)])
    assert min(map(m.score, (*bad, new))) > 3 * m.threshold > m.threshold > max(map(m.score, good))


def test_short_segments_are_scored(model):
    assert toxicity.segments("cow\n你好。白痴 | -- | ***") == ["cow", "你好。", "白痴 "]
    m = toxicity.fit([(f"the town is old\n{'gup' if i % 4 == 0 else 'hall'}", float(i % 4 == 0)) for i in range(40)])
    assert m.score("gup") > 0.5 > m.score("hall")


def test_identity_terms_hardly_change_scores():
    docs = [("the muslims held a market", 0.0), ("the town of the jews is old", 0.0), ("muslims are vermin", 1.0), ("muslims are rats", 1.0), ("gay people are vermin", 1.0)] * 3

    def gap(swap, **more):
        m = toxicity.fit(docs, swap=swap, **more)
        s = [m.segment_score(f"the {w} held a market in the town") for w in ("muslims", "jews", "christians", "hindus")]
        return max(s) - min(s)

    without = gap(0.0, mention=0.0)
    assert gap(0.5) < 0.5 * without + 1e-9
    assert gap(toxicity.fit.__kwdefaults__["swap"]) < 0.5 * without + 1e-9


MENTIONS = ["{} people are welcome here", "{} live in this town", "my neighbours are {} and kind", "two {} women run the shop", "a museum about {} opened", "{}"]


@pytest.mark.parametrize("labels", [[], [("the muslims held a market", 0.0), ("you stupid idiot", 1.0), ("gay people are vermin", 1.0)] * 3])
def test_neutral_mentions_of_every_group_stay_below_the_threshold(labels):
    m = toxicity.fit(labels)
    english = [w for group in IDENTITY[:5] for w in group]
    assert {w: m.score(f.format(w)) for w in english for f in MENTIONS if m.score(f.format(w)) >= m.threshold} == {}
    assert max(m.score(w) for group in IDENTITY for w in group) < m.threshold
    assert min(m.score(x) for x in ("gay people are vermin", "muslims are rats", "black people are animals, kill them")) > m.threshold


def test_unknown_words_are_never_flagged(model):
    assert model.threshold > 1.5 * model.score("qwx zzyv plorm")
    assert max(map(model.score, ("qwx zzyv plorm", "Qwx Zzyv", "Ђуро њива", "12 km", "გამარჯობა მსოფლიო"))) < model.threshold


@pytest.mark.parametrize("text", ["傻逼", "你是个白痴", "ты тупой идиот", "お前は馬鹿だ", "sei un idiota", "너는 멍청한 새끼야", "أنت غبي حقير", "תסתום את הפה, זבל", "sen bir aptalsın"])
def test_abuse_in_further_languages(model, text):
    assert model.score(text) > 0.5
    assert model.score(f"The town has a market hall. <i>{text}</i> It is old.") > 0.5


def test_held_out_documents(spark, sf_dir):
    """Trained on two thirds of noisy labels, the rest is told apart far better than by chance."""
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/review_labels.parquet")
    m = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    rest = labels.where("doc_id % 3 = 0 and toxic is not null").groupBy("doc_id").avg("toxic").withColumnsRenamed({"avg(toxic)": "y"})
    got = toxicity.scored(docs.join(rest, "doc_id"), m, keep={"y": "y"}).toPandas()
    hit, calm = got[got["y"] > 0.5]["score"], got[got["y"] < 0.5]["score"]
    assert (calm >= m.threshold).mean() < 0.03 and (hit >= m.threshold).mean() > 0.6  # about a quarter of the positive labels are wrong


def test_rates_and_edges(spark, model, monkeypatch):
    df = spark.createDataFrame([(1, "you are a stupid idiot", "A b", 1), (2, None, "a_B", 2), (3, "", None, 3), (3, "The river is long.", None, 3)], "doc_id bigint, text string, source string, score int")
    got = toxicity.scored(df, model, keep={"source": "source"})
    assert got.count() == 4
    r = {x["source"]: (x["n_docs"], x["n_flagged"]) for x in toxicity.rates(got).collect()}
    assert r == {"a_b": (2, 1), None: (2, 0)}
    assert toxicity.scored(df.where("false"), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda documents, **_: taken.append(len(documents)))
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(40)], "doc_id bigint, text string")
    votes = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None)], "doc_id bigint, toxic int")
    for bounds in ({}, {"max_labelled": 12}, {"max_characters": 75}):
        toxicity.train(docs, votes, **bounds)
    assert taken == [30, 12, 7]
    monkeypatch.undo()
    assert toxicity.train(df, none).score("you stupid idiot") > 0.5
