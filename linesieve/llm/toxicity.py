"""Abusive, hateful or sexual content: a counterfactually regularised classifier over disguised text.

Texts are cut into short segments; words are read through the usual disguises (width, look-alike letters,
stretching, digits for letters, spaced letters, masked letters, swapped inner letters). A logistic model
over words and word pairs scores each segment; a document has the score of its worst segment.

The model is fitted on labelled sentences and on a bounded sample of reviewed documents. A document's
label says only that some segment is abusive, or none: the segments of positive documents that the model
finds worst are taken as positive, all segments of negative ones as negative, and the fit is repeated.
For every labelled sentence with an identity term, copies with another term of its group are made, and the
squared difference of the scores is part of the loss, as is that of a bare term against no text at all;
neutral frames are filled with every term. Names and unknown words have no weight of their own. The
threshold is set by the fit, above the score of text that consists of unknown words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import normal_source
from .toxic_seeds import ABUSIVE, FRAMES, IDENTITY, NEUTRAL

#: Letters that look like Latin ones, and signs used for letters.
LOOKALIKE = dict(zip("аеорсухіѕјкмтвнАЕОРСУХІКМТВНαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjkmtbhAEOPCYXIKMTBHaopviktuABEZHIKMNOPTYX"))
SIGNS = dict(zip("0134578$@€!|", "oieastbsaeil"))
MASK = "*#_%+"

_SPLIT = re.compile(r"\n+|\[\[|\]\]|\{\{|\}\}|\|+|={2,}|<!--|-->|--+|!!|(?<=[.!?;:])\s+|(?<=[。｡！？；؟۔।])\s*")
_TAG = re.compile(r"<(?!!--)([^<>]{0,200})>")
_ATTRIBUTE = re.compile(r"=\s*[\"']|[\"']\s*(?=/?\s*$|[\w:.-]+\s*=)")
#: Vowel signs that fold() keeps; they belong to a word but aren't in \w.
_SIGN = "".join(chr(c) for c in range(0x900, 0x1100) if unicodedata.category(chr(c)) == "Mc")
_SPACED = re.compile(rf"(?<![\w{_SIGN}])\w([-._*~ ])\w(?:\1\w)+(?![\w{_SIGN}])[-.]?")
_TOKEN = re.compile(r"[^\s.,;:!?\"()\[\]{}<>=/\\«»“”„‹›¡¿…—–|。｡、､・「」『』《》〈〉【】،؛؟۔।॥]+")
#: Thai to Myanmar, Khmer, Japanese and Chinese: written without blanks between words.
_UNSPACED = re.compile("([฀-႟ក-៿々-〇぀-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+)")
_LETTER = re.compile(r"[^\W_]")
_STRETCH = re.compile(r"(.)\1+")
_FORMAT = re.compile("[­͏​-‏‪-‮⁠-⁤﻿]")


def fold(text: str) -> str:
    """Without format characters, width and compatibility forms, accents and look-alike letters in Latin words."""
    if text.isascii():
        return text
    text = _FORMAT.sub("", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    if any("Ͱ" <= c <= "ӿ" for c in text):
        words = []
        for w in re.split(r"(\W+)", text):
            other = sum("Ͱ" <= c <= "ӿ" for c in w)
            if other and all(c in LOOKALIKE or c < "Ͱ" for c in w):
                w = "".join(LOOKALIKE.get(c, c) for c in w)
            words.append(w)
        text = "".join(words)
    return text


def skeleton(word: str) -> str:
    """First letter, set of letters, last letter: equal for a word and its stretched or scrambled forms."""
    w = _STRETCH.sub(r"\1", word.lower().strip("'’-"))
    return w if len(w) < 4 else w[0] + "".join(sorted(set(w))) + w[-1]


def segments(text: str) -> list[str]:
    """Pieces of a text that are scored by themselves; what stands in a tag, and each attribute's value, is one too."""
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" + _ATTRIBUTE.sub("\n", m[1]) + "\n", text)
    return [s for s in _SPLIT.split(text) if _LETTER.search(s)]


def raw_words(segment: str) -> list[str]:
    """Words of a folded segment; spaced letters are joined, scripts without blanks are cut into pairs of letters."""
    if "." in segment or "-" in segment or " " in segment:
        if _SPACED.search(segment):
            segment = _SPACED.sub(lambda m: re.sub(r"[-._*~ ]", "", m.group()) + " ", segment)
    words = _TOKEN.findall(segment)
    if segment.isascii() or not _UNSPACED.search(segment):
        return words
    out = []
    for w in words:
        for k, part in enumerate(_UNSPACED.split(w)):
            if part:
                out += [part[i : i + 2] for i in range(max(1, len(part) - 1))] if k % 2 else [part]
    return out


def _is_word(word: str) -> bool:
    return word.isalpha() or word[:1].isalpha() and all(c.isalpha() or c in _SIGN for c in word)


UNKNOWN, NAME = 0, 1
#: A fit's threshold is at least this, and this many times the score of unknown words.
LEAST_THRESHOLD, ABOVE_UNKNOWN = 0.08, 2.5


@dataclass
class Vocabulary:
    """Word skeletons to numbers; 0 stands for unknown words and 1 for unknown capitalised words."""

    ids: dict[str, int]
    words: list[str] = field(default_factory=list)
    known: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"ids": self.ids, "words": self.words, "known": {}}

    @property
    def size(self) -> int:
        return len(self.ids) + 2

    def number(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            got = self._number(word)
            if len(word) < 48:
                self.known[word] = got
        return got

    def _number(self, word: str) -> int:
        ids = self.ids
        if (i := ids.get(skeleton(word))) is not None:
            return i
        if any(c in SIGNS for c in word) and any(c.isalpha() for c in word):
            for one in "il":
                if (i := ids.get(skeleton("".join(one if c == "1" else SIGNS.get(c, c) for c in word)))) is not None:
                    return i
        masked = sum(c in MASK for c in word)
        if masked and masked < len(word) / 2 and sum(c.isalpha() for c in word) >= 2:
            pattern = re.compile("".join("[a-z]" if c in MASK else re.escape(c) for c in word.lower()))
            for w in self.words:
                if len(w) == len(word) and pattern.fullmatch(w):
                    return ids[skeleton(w)]
        if len(word) > 3 and word.isalpha():  # a spaced word that took a single letter with it
            for part in (word[1:], word[:-1]):
                if word[:1] in "IiAa" and part is not word[:-1] and (i := ids.get(skeleton(part))) is not None and not word[1:2].isupper() and word[0].isupper():
                    return i
        return NAME if word[:1].isupper() and not word.isupper() else UNKNOWN

    def numbers(self, segment: str) -> list[int]:
        known, out = self.known, []
        for w in raw_words(segment):
            i = known.get(w)
            out.append(self.number(w) if i is None else i)
        return out


def features(ids: list[int], size: int) -> list[int]:
    """Distinct words and pairs of neighbouring words of a segment."""
    out = {i for i in ids if i > NAME}
    for a, b in zip(ids, ids[1:]):
        if a > UNKNOWN or b > UNKNOWN:
            out.add(size + a * size + b)
    return sorted(out)


@dataclass
class Model:
    """Weights by feature, and the offset."""

    vocabulary: Vocabulary
    weights: dict[int, float]
    offset: float
    threshold: float = LEAST_THRESHOLD

    def segment_score(self, segment: str) -> float:
        get, size = self.weights.get, self.vocabulary.size
        ids = self.vocabulary.numbers(segment)
        z = self.offset + sum(get(f, 0.0) for f in features(ids, size))
        return z

    def score(self, text: str | None, seen: dict[str, float] | None = None) -> float:
        """Probability that the worst segment of a text is abusive; 0 for null and empty texts.

        ``seen`` remembers lines, which revisions of a page share.
        """
        worst = -np.inf
        if text:
            for line in text.split("\n"):
                z = seen.get(line) if seen is not None else None
                if z is None:
                    z = max((self.segment_score(fold(s)) for s in segments(line)), default=-np.inf)
                    if seen is not None and len(line) < 2000:
                        if len(seen) > 1 << 16:
                            seen.clear()
                        seen[line] = z
                if z > worst:
                    worst = z
        return float(1.0 / (1.0 + np.exp(-max(worst, -60.0)))) if worst > -np.inf else 0.0


#: Place of each identity term, folded, in its group. Unaccented, one of them is an English word.
_PLACE = {fold(w): (g, k) for g, group in enumerate(IDENTITY) for k, w in enumerate(group)}
_OTHER_WORDS = ("manner",)


def _swaps(sentence: str, copies: int | None = None) -> list[str]:
    """Copies of a sentence, not yet folded, with one identity term replaced by each other one of its group, or by the next ``copies``."""
    low = sentence.lower().split()
    hits = []
    for i, w in enumerate(low):
        core = w.strip(".,;:!?")
        if core not in _OTHER_WORDS and (at := _PLACE.get(fold(core))):
            hits.append((at[0], i, at[1]))
    out = []
    for g, i, k in sorted(hits):
        group = IDENTITY[g]
        for j in range(1, len(group) if copies is None else min(copies + 1, len(group))):
            out.append(" ".join([*low[:i], group[(k + j) % len(group)], *low[i + 1 :]]))
    return out


class _Rows:
    """Sparse rows of features as flat arrays."""

    def __init__(self, rows: list[tuple[int, ...]], index: dict[int, int]):
        self.at = np.array([index[f] for r in rows for f in r if f in index], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [sum(f in index for f in r) for r in rows])
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], size)


def _framed() -> list[str]:
    return [frame.format(term, term) for groups, frames in FRAMES for g in groups for term in IDENTITY[g] for frame in frames]


def _logistic(rows: list[tuple[int, ...]], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[tuple[int, ...], tuple[int, ...]]], *, ridge: float, swap: float, bare: list[tuple[int, ...]] = (), mention: float = 0.0, rounds: int = 250) -> tuple[dict[int, float], float]:
    """Weighted logistic regression with a ridge, a penalty on squared score differences of ``pairs``, and one on what ``bare`` rows add to the offset, by Adam."""
    index: dict[int, int] = {}
    for r in [*rows, *(p for pair in pairs for p in pair), *bare]:
        for f in r:
            index.setdefault(f, len(index))
    n = len(index)
    x, a, b, e = _Rows(rows, index), _Rows([p for p, _ in pairs], index), _Rows([q for _, q in pairs], index), _Rows(list(bare), index)
    w, c = np.zeros(n), -2.0
    m, v, mc, vc = np.zeros(n), np.zeros(n), 0.0, 0.0
    total = weight.sum()
    for t in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(x.dot(w) + c, -30, 30)))
        g = weight * (p - y) / total
        grad = x.back(g, n) + ridge * w / total
        if len(pairs):
            d = a.dot(w) - b.dot(w)
            grad += swap * 2 / len(pairs) * (a.back(d, n) - b.back(d, n))
        if len(bare):
            grad += mention * 2 / len(bare) * e.back(e.dot(w), n)
        gc = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc * gc
        step = 0.15 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        c -= step * (mc / (1 - 0.9**t)) / (np.sqrt(vc / (1 - 0.999**t)) + 1e-8)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, float(c)


def fit(documents: list[tuple[str, float]], *, rounds: int = 4, ridge: float = 0.2, swap: float = 0.02, mention: float = 0.5, swaps_per_segment: int = 1, least_docs: int = 2) -> Model:
    """Fit on (text, share of reviewers who found it abusive) pairs and the seed sentences; works without documents.

    ``swap`` and ``mention`` weigh the counterfactual penalties. A labelled seed gives a pair for every other
    term of a group, a segment of a document for the next ``swaps_per_segment`` terms.
    """
    framed = _framed()
    seeds = [(s, 1.0) for s in ABUSIVE.splitlines() if s] + [(s, 0.0) for s in NEUTRAL.splitlines() if s] + [(s, 0.0) for s in framed]
    cuts = [(list(dict.fromkeys(segments(t))), y) for t, y in documents if t and y != 0.5]
    docs = [([fold(s) for s in segs], y) for segs, y in cuts]
    seen: Counter[str] = Counter()
    for segs, _ in docs:
        # Names are no words: a capitalised word counts only if its segment is all capitals. Many scripts have no case.
        seen.update({w.lower() for s in segs for w in raw_words(s) if _is_word(w) and (w.islower() or s.isupper() or w.lower() == w.upper())})
    words = Counter({w: n for w, n in seen.items() if n >= least_docs and len(w) < 30})
    plain = [w for s, _ in seeds for w in raw_words(fold(s)) if _is_word(w)]
    words.update({w.lower(): 1000 for w in plain})
    for group in IDENTITY:
        words.update({fold(w): 1 for w in group})
    ordered = [w for w, _ in words.most_common()]
    ids: dict[str, int] = {}
    for w in ordered:
        ids.setdefault(skeleton(w), len(ids) + 2)
    vocabulary = Vocabulary(ids, [w for w in ordered if 2 < len(w) < 20])
    size = vocabulary.size
    made: dict[str, tuple[int, ...]] = {}

    def of(segment: str) -> tuple[int, ...]:
        """Features; revisions of a page share most segments, and these share one tuple."""
        if segment not in made:
            made[segment] = tuple(features(vocabulary.numbers(segment), size))
        return made[segment]

    seed_rows, seed_y = [of(fold(s)) for s, _ in seeds], [y for _, y in seeds]
    pairs = [(of(fold(s)), of(fold(t))) for s, _ in seeds[: -len(framed)] for t in _swaps(s)]
    bare = [of(fold(term)) for group in IDENTITY for term in group]
    rows_of = [([of(s) for s in segs], y) for segs, y in docs]
    shared = dict.fromkeys(s for segs, _ in cuts for s in segs)  # a segment that documents share gives its pairs once
    pairs += [(of(fold(s)), of(fold(t))) for s in shared for t in _swaps(s, swaps_per_segment)]
    negative = Counter(r for rows, y in rows_of if y < 0.5 for r in rows)
    among = Counter(r for rows, y in rows_of if y > 0.5 for r in set(rows))
    usual = lambda r: max(0.0, negative[r] - 1.0 - 0.3 * among[r])
    positive: Counter[tuple[int, ...]] = Counter()
    others: Counter[tuple[int, ...]] = Counter()
    score = lambda r: -1.0
    for k in range(rounds + 1):
        calm = negative + others
        for r in positive:
            calm.pop(r, None)
        # The first row has no features: text of unknown words is no case.
        rows = [(), *seed_rows, *positive, *calm]
        y = np.array([0.0, *seed_y, *[1.0] * len(positive), *[0.0] * len(calm)])
        # Copies of a segment count by the square root of their number; a negative document may be labelled wrongly.
        weight = np.r_[100.0, np.where(np.array(seed_y) > 0, 4.0, 2.0), 3.0 * np.sqrt([positive[r] for r in positive]) if positive else [], [np.sqrt(n) * (0.1 if score(r) > 0 and n <= 2 else 1.0) for r, n in calm.items()]]
        # the fits before the last only choose segments
        model = _logistic(rows, y, weight, pairs, ridge=ridge, swap=swap, bare=bare, mention=mention, rounds=250 if k == rounds else 100)
        weights, offset = model
        score = lambda r: offset + sum(weights.get(f, 0.0) for f in r)  # noqa: B023, E731
        positive, others = Counter(), Counter()
        for rows, y in rows_of:
            if y > 0.5 and rows:
                # A segment that is usual in negative documents can't be the reason for the label; a few
                # copies there may be labels gone wrong. A document none of whose segments stands out is
                # taken as labelled wrongly itself.
                best, *rest = sorted(set(rows), key=lambda r: score(r) - usual(r), reverse=True)
                top = score(best)
                lead = top - max((score(r) for r in rest), default=offset)
                if not usual(best) and (top > -0.5 or top > -3.2 and lead > 1.0):
                    positive[best] += 1
                    others.update(r for r in rest if score(r) < -1.0)
    weights, offset = model
    return Model(vocabulary, weights, offset, max(LEAST_THRESHOLD, ABOVE_UNKNOWN / (1.0 + np.exp(-offset))))


def _score(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for rb in batches:
            out = [model.score(t, seen) for t in rb.column(text_at).to_pylist()]
            keep = [i for i in range(rb.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in keep), pa.array(out, pa.float64())], names=[*(rb.schema.names[i] for i in keep), "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000, max_characters: int = 100_000_000, **options) -> Model:
    """Fit on at most ``max_labelled`` reviewed documents (the smallest hashes of their ids), of ``max_characters`` together.

    Several judgements of a document are averaged, null judgements and documents without text are left
    out. These bounds hold for the fit only, whose sample is collected; every document is scored in whole.
    """
    votes = labels.where("toxic is not null").groupBy(F.col(id_col).alias("_id")).agg(F.avg("toxic").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(votes, "_id").where(F.col("_text").isNotNull())
    texts = texts.withColumn("_hash", F.xxhash64("_text"))
    upto = F.sum("_length").over(Window.orderBy(F.xxhash64("_id"), "_id", "_hash"))  # over lengths, at most a row a labelled document
    kept = texts.select("_id", "_hash", F.length("_text").alias("_length")).withColumn("_upto", upto).where(F.col("_upto") <= max_characters)
    got = texts.join(kept.select("_id", "_hash"), ["_id", "_hash"], "left_semi").select("_id", "_text", "y").toPandas().sort_values("_id", kind="stable")
    return fit(list(zip(got["_text"], got["y"])), **options)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """``id``, the columns of ``keep`` and ``score`` of every document, null and empty texts (score 0) included."""
    keep = keep or {}
    chosen = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(n) for n, c in keep.items()), F.col(text_col).alias("_text"))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in ["id", *keep]) + ", score double"
    return chosen.mapInArrow(_score(model, len(keep) + 1), schema)


def rates(scores: DataFrame, threshold: float = LEAST_THRESHOLD) -> DataFrame:
    """Per source (spelled alike; null is a source of its own): documents, flagged ones, their share and the mean score."""
    flagged = F.col("score") >= threshold
    return (
        scores.groupBy(normal_source(F.col("source")).alias("source"))
        .agg(F.count("*").alias("n_docs"), F.count_if(flagged).alias("n_flagged"), F.avg("score").alias("mean_score"))
        .withColumn("flagged_share", F.col("n_flagged") / F.col("n_docs"))
    )
