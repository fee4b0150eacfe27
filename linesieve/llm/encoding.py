"""Text that was decoded with the wrong character encoding: finding it and mapping it back.

A token is judged by how unnatural its neighbouring characters are (``oddness``). An odd token is mapped
back to the bytes of a legacy encoding; a byte-structure automaton finds the maximal well-formed
multibyte spans, and only those spans are decoded: first UTF-8 spans, then two-byte East Asian ones.
Bytes of a single-byte encoding that were read as another one have no structure; such tokens are
re-read whole. A reading counts only if its characters are common and it is less odd than the token.

Garbled tokens that look natural (one accented letter for another) can't be told by themselves. For them
every plausible other reading is looked up among the terms of the whole collection: a reading that is
a frequent term, far more frequent than the token itself, is taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slots

#: Encodings that bytes may have been read with, most usual first.
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1254", "iso8859_2", "cp1253", "cp852", "cp1257")
#: Single-byte encodings that they may have been written in.
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp1254", "cp1253", "cp866", "cp437", "cp850", "mac_roman")
#: Pairs (read as, written in) that are tried on tokens which look natural.
QUIET = (("cp1252", "iso8859_2"), ("cp1252", "cp1250"), ("cp1252", "cp1254"), ("cp1252", "cp1253"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8_r"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1254", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp1257", "cp1252"))
#: Two-byte encodings with the lead bytes of their frequent characters (kana, syllables, first-level ideographs).
TWO_BYTE = (("euc_kr", ((0xB0, 0xC8),)), ("gbk", ((0xB0, 0xD7),)), ("shift_jis", ((0x82, 0x83), (0x88, 0x97))), ("euc_jp", ((0xA4, 0xA5), (0xB0, 0xCF))), ("big5", ((0xA4, 0xC6),)))

#: Symbols that may stand before or after a word, or join two words.
BEFORE, AFTER, JOIN = set("¿¡«‹“‘„‚°→№•§©€£¥–—…"), set("»›”’…™®©°ªº²³¹†‡·–—•→%‰ΩΩ"), set("’‘·–—‑‐―→←↔≠≤≥≈−×/⁄∙…")
_QUOTES = set("«»“”‘’„‚‹›—–…")
#: Letters with marks in common use.
_LATIN = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœøåæðþ" "ąćęłńóśźżčďěňřšťůžľĺŕăâîșțşţőűğıİđāēīūģķļņėįųõ" "ơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹĩũ")
_LATIN |= {c.upper() for c in _LATIN}
_CYRILLIC = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯіїєґІЇЄҐ")
_GREEK = set("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ")
_SIGNS = set("–—‘’“”„‚†‡•…‰‹›€™№−≈≠≤≥→←♥★☆✓☕♪﻿​‍") | {chr(c) for c in range(0xA0, 0x100)}
_VOWELS = {"C": set("аеёиоуыэюяіїє"), "G": set("αεηιουωάέήίόύώϊϋ"), "L": set("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœąęěůıăőűơưĩũ")}


_KINDS: dict[str, tuple[str, str]] = {}
_TABLES: dict[str, dict[str, int]] = {}


def kind(c: str) -> tuple[str, str]:
    """Class and script of a character, remembered; see :func:`_kind`."""
    got = _KINDS.get(c)
    if got is None:
        got = _KINDS[c] = _kind(c)
    return got


def _kind(c: str) -> tuple[str, str]:
    """(class, script): u, l, o letters; d digits; s symbols; q joining signs; b line drawing; c C1 controls; r U+FFFD; i ignorable; w white space; p ASCII punctuation."""
    o = ord(c)
    if o < 0x80:
        return ("u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "d" if "0" <= c <= "9" else "p" if o >= 0x20 else "i", "L" if c.isalpha() else "")
    if o < 0xA0:
        return "c", ""
    if o == 0xFFFD:
        return "r", ""
    if c in "ƒµªº" or 0x2B0 <= o < 0x300:
        return "s", ""
    cat = unicodedata.category(c)
    if cat in ("Mn", "Cf", "Mc", "Me"):
        return "i", ""
    if cat[0] == "Z":
        return "w", ""
    if 0x2500 <= o < 0x2580:
        return "b", ""
    if cat[0] == "L":
        name = unicodedata.name(c, "")
        script = "L" if "LATIN" in name or 0xFF21 <= o <= 0xFF5A else "C" if "CYRILLIC" in name else "G" if "GREEK" in name else "H" if "HANGUL" in name else "J" if o >= 0x2E80 else "X"
        return ("u" if cat in ("Lu", "Lt") else "l" if cat == "Ll" else "o"), script
    if cat[0] == "N" and c not in "²³¹½¼¾":
        return ("d", "") if cat == "Nd" else ("s", "")
    return "s", ""


_LETTER = ("u", "l", "o")


def oddness(token: str) -> int:
    """Number of unnatural neighbourhoods in a token without blanks; 0 for natural text of any script."""
    seq = [(c, *kind(c)) for c in token]
    seq = [x for i, x in enumerate(seq) if x[1] != "i" or (x[0] == "\xad" and i and seq[i - 1][0] in "ÂÃ")]
    if len(seq) > 1 and all(x[1] == "b" for x in seq):
        return 0
    odd, run, high = 0, 0, 0
    last = len(seq) - 1
    for i, (c, k, script) in enumerate(seq):
        if k in ("c", "r"):
            odd += 2
        wide = "\xa0" <= c <= "\xff" or k == "s" and c not in JOIN
        run = run + 1 if wide else 0
        high = high + 1 if wide and k in _LETTER else high if wide else 0
        if run == 4 and high >= 1 or run > 4 and high == 1 and k in _LETTER:
            odd += 1
        if not i:
            if k == "s" and last and seq[1][1] in _LETTER and c not in BEFORE and c != "µ":
                odd += 1
            continue
        a, ka, sa = seq[i - 1]
        nxt = seq[i + 1] if i < last else ("", "", "")
        if ka in _LETTER and k in _LETTER:
            if sa != script and {sa, script} != {"L", "X"}:
                odd += not (a == "Μ" and c in "SGM")
            elif ka == "l" and k == "u" and (ord(a) > 127 or ord(c) > 127):
                odd += 1
        elif ka in _LETTER and k == "s" and c in JOIN and nxt[1] in _LETTER and {sa, nxt[2]} in ({"L", "C"}, {"L", "G"}, {"C", "G"}):
            odd += 1
        elif ka in _LETTER and k in ("s", "w", "i"):
            if a in "ÂÃ" or (ka == "u" and ord(a) > 127 and sa == "L" and k == "s" and c not in "»”’…™®·"):
                odd += 1
            elif k == "s" and c == "µ" or k == "s" and c not in AFTER and c not in JOIN:
                odd += 1
            elif k == "s" and nxt[1] in _LETTER and c not in JOIN:
                odd += 1
        elif ka == "s" and k in _LETTER:
            if i >= 2 and seq[i - 2][1] in _LETTER:
                pass  # counted above
            elif a not in BEFORE and a not in JOIN and a != "µ":
                odd += 1
        elif ka == "s" and k == "s" and i >= 2 and seq[i - 2][1] in _LETTER and nxt[1] in _LETTER and not {a, c} <= _QUOTES:
            odd += 1
        elif ka == "s" and k == "s" and a != c and (a in "¬√∂∆∑∏∫Ω≈◊ƒ¦¨¯¸´" or c in "ƒ¦¨¯¸´¶¤") and a not in JOIN:
            odd += 1
        elif "b" in (ka, k) and ka != k and "w" not in (ka, k) and "p" not in (ka, k):
            odd += 1
        elif ka == "d" and k in _LETTER and ord(c) > 127 and script in "LCG" or k == "d" and ka in _LETTER and ord(a) > 127 and sa in "LCG":
            odd += 1
    return odd


def common(c: str) -> bool:
    """Characters that a right reading consists of."""
    if c < "\x80":
        return c >= " " or c in "\t\r\n"
    o = ord(c)
    return c in _LATIN or c in _CYRILLIC or c in _GREEK or c in _SIGNS or 0x4E00 <= o < 0xA000 or 0x3000 <= o < 0x3100 or 0xAC00 <= o < 0xD7A4 or 0xFF01 <= o < 0xFF66 or 0x1F300 <= o < 0x1FB00 or 0x2190 <= o < 0x2200 or 0x2500 <= o < 0x2700 or 0x5D0 <= o < 0x5EB or 0x620 <= o < 0x64B or 0xE01 <= o < 0xE5C


def to_byte(charset: str) -> dict[str, int]:
    """Characters above ASCII to bytes; bytes without a character stand for the C1 controls, as lenient decoders have them."""
    if charset in _TABLES:
        return _TABLES[charset]
    out = _TABLES[charset] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if charset == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _structure(b: int) -> str:
    return "c" if b < 0xC0 else "2" if 0xC2 <= b < 0xE0 else "3" if 0xE0 <= b < 0xF0 else "4" if 0xF0 <= b < 0xF5 else "x"


#: The automaton over byte classes: maximal runs of well-formed multibyte sequences.
_SPANS = re.compile("(?:2c|3cc|4ccc)+")
_UNIT = re.compile("2c|3cc|4ccc")


def utf8_spans(token: str, charset: str, strict: bool = True) -> str | None:
    """The token with every well-formed UTF-8 span decoded, or None if there is none or (strict) one decodes to uncommon characters."""
    table = to_byte(charset)
    found = [table.get(c) if c >= "\x80" else None for c in token]
    shape = "".join("a" if b is None else _structure(b) for b in found)
    out, at, any_ = [], 0, False
    for m in _SPANS.finditer(shape):
        try:
            text = bytes(found[m.start() : m.end()]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if strict and not all(map(common, text)):
            return None
        out += [token[at : m.start()], text]
        at, any_ = m.end(), True
    return "".join(out) + token[at:] if any_ else None


def utf8_spans_any_case(token: str, charset: str, most: int = 8) -> list[str]:
    """Like :func:`utf8_spans` for text whose case was changed after the garbling: a letter may stand for its other case.

    A changed case can leave several readings; up to ``most`` are given.
    """
    table = to_byte(charset)
    ways = [[b for b in dict.fromkeys(table.get(x) for x in (c, c.upper(), c.lower()) if len(x) == 1) if b is not None] if c >= "\x80" else [] for c in token]
    outs, i, any_ = [""], 0, False
    while i < len(token):
        hits: dict[str, None] = {}
        n = 1
        for n in (2, 3, 4):
            for w in product(*ways[i : i + n]) if i + n <= len(token) and all(ways[i : i + n]) else ():
                if _UNIT.fullmatch("".join(map(_structure, w))):
                    try:
                        text = bytes(w).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if common(text) and kind(text)[0] in _LETTER:
                        hits[text.lower() if token.lower() == token else text] = None
            if hits:
                break
        if hits:
            outs = [o + h for o in outs for h in hits][:most]
            i, any_ = i + n, True
        else:
            outs = [o + token[i] for o in outs]
            i += 1
    return list(dict.fromkeys(outs)) if any_ else []


def two_byte(token: str) -> list[str]:
    """Readings of the token's runs of high characters in two-byte encodings, frequent characters only, at least two of them."""
    table, out = to_byte("cp1252"), []
    for name, leads in TWO_BYTE:
        bad, done = False, False
        parts = re.split(r"([^\x00-\x20]+)" if name == "shift_jis" else r"([^\x00-\x7f]+)", token)
        for i in range(1, len(parts), 2):
            raw = bytes(table.get(c, 0) if c >= "\x80" else ord(c) for c in parts[i])
            high = sum(b >= 0x80 for b in raw)
            if high < 3:
                bad = bad or high > 0
                continue
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                bad = True
                continue
            at, ok, wide = 0, True, 0
            for c in text:
                n = len(c.encode(name))
                if n > 1:
                    wide += 1
                    ok = ok and any(a <= raw[at] <= b for a, b in leads)
                elif c >= "\x80":
                    ok = False
                at += n
            if not ok or wide < 2:
                bad = True
                continue
            parts[i], done = text, True
        if done and not bad:
            out.append("".join(parts))
    return out


def _reread(token: str, read_as: str, written_in: str) -> str | None:
    table = to_byte(read_as)
    try:
        raw = bytes(table[c] if c >= "\x80" else ord(c) for c in token)
        text = raw.decode(written_in)
    except (KeyError, UnicodeDecodeError):
        return None
    return text if text != token and all(map(common, text)) else None


def _word_like(text: str) -> bool:
    """Letters of one script in usual case order, with a vowel."""
    letters = [c for c in text if kind(c)[0] in _LETTER]
    scripts = {kind(c)[1] for c in letters}
    if len(scripts) != 1 or len(letters) < 2:
        return False
    script = scripts.pop()
    if any(c >= "\x80" and kind(c)[0] in ("s", "b", "c", "r") and c not in "’‘–" for c in text) or any(c in "ðþÐÞ" for c in text):
        return False
    low = [c for c in letters if kind(c)[0] == "l"]
    cased = not low or len(low) >= len(letters) - 1 and (len(low) == len(letters) or kind(letters[0])[0] == "u")
    return cased and any(c.lower() in _VOWELS.get(script, ()) for c in letters)


def _utf8_reading(token: str, was: int, depth: int = 0) -> str | None:
    """The least odd reading by UTF-8 spans, of text that was read wrongly up to three times."""
    best: tuple[int, int, str] | None = None
    for k, charset in enumerate(READ_AS):
        text = utf8_spans(token, charset, strict=False)
        if text is None:
            continue
        again = oddness(text)
        if again and depth < 2 and (more := _utf8_reading(text, again, depth + 1)) is not None:
            text, again = more, oddness(more)
        if again < was and all(map(common, text)):
            if not again:
                return text
            best = min(best or (again, k, text), (again, k, text))
    return best[2] if best else None


def readings(token: str) -> list[str]:
    """Better readings of an odd token, best first; empty if there is none."""
    was = oddness(token)
    if not was:
        if sum(kind(c)[0] == "b" for c in token) >= 2:  # line drawing that spells letters
            for charset in ("cp437", "cp866", "koi8_r", "cp850"):
                text = utf8_spans(token, charset)
                if text is not None and all(kind(c)[0] in _LETTER for c in text):
                    return [text]
        return []
    if (text := _utf8_reading(token, was)) is not None:
        return [text]
    for charset in ("cp1252", "mac_roman", "cp1250", "cp1251", "koi8_r"):
        if texts := [t for t in utf8_spans_any_case(token, charset) if oddness(t) == 0]:
            return texts
    if wide := [t for t in two_byte(token) if oddness(t) == 0]:
        return wide
    out = []
    for written_in in WRITTEN_IN:
        for read_as in READ_AS:
            if read_as != written_in:
                text = _reread(token, read_as, written_in)
                if text is not None and oddness(text) == 0 and _word_like(text) and text not in out:
                    out.append(text)
    return out


def quiet_readings(token: str) -> list[str]:
    """Other readings of a natural-looking token, to be confirmed by the terms of the collection."""
    out = []
    for read_as, written_in in QUIET:
        text = _reread(token, read_as, written_in)
        if text is not None and _word_like(text):
            out.append(text)
    for charset in ("cp1252", "mac_roman", "cp1250", "cp1251"):
        for text in (utf8_spans(token, charset), *utf8_spans_any_case(token, charset)):
            if text is not None and oddness(text) == 0:
                out.append(text)
    return list(dict.fromkeys(t for t in out + two_byte(token) + readings(token) if t != token))


_BLANKS = re.compile(r"([ \t\r\n\x0b\x0c\x1c-\x1f]+)")
_EDGE = ".,;:!?\"'()[]{}<>#*=|/\\_+-&%$@^`~0123456789"
_INNER = re.compile(r"([,;:/\\|=&?!()\[\]{}<>\"#*+_.-]+)")


def _cores(piece: str) -> list[str]:
    """What is looked up of a piece: itself, and its parts between separators (fields, steps of a path)."""
    each = [piece, *_INNER.split(piece)[::2]]
    return [c for c in dict.fromkeys(e.strip(_EDGE) for e in each) if c and not c.isascii()]


class Repairer:
    """Repairs lines token by token and remembers tokens (up to ``limit``)."""

    def __init__(self, limit: int = 1 << 17):
        self.known: dict[str, tuple[int, str, bool]] = {}
        self.limit = limit

    def token(self, token: str) -> tuple[int, str, bool]:
        """(0 natural, 1 garbled and mapped back, 2 garbled and lost), the token's best text, and whether there are others."""
        got = self.known.get(token)
        if got is None:
            if len(token) > 400:  # long pieces without blanks are judged in parts, split before ASCII letters and digits
                parts = re.split(r"(?<=[\x21-\x7e])(?=[\x21-\x7e])", token)
                if len(parts) > 1:
                    each = [self.token(p) if not p.isascii() else (0, p, False) for p in parts]
                    return max(k for k, _, _ in each), "".join(t for _, t, _ in each), any(m for _, _, m in each)
            if options := readings(token):
                got = (2 if any(kind(c)[0] in ("r", "c") for c in options[0]) else 1, options[0], len(options) > 1)
            else:
                got = (2 if any(kind(c)[0] in ("r", "c") and c != "\x85" for c in token) else 0, token, False)
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(token) < 200:
                self.known[token] = got
        return got

    def line(self, line: str) -> tuple[int, str, list[str]]:
        """State of a line (as of its worst token), its best text, and its tokens above ASCII that are natural or have several readings."""
        state, out, quiet = 0, [], []
        for piece in _BLANKS.split(line):
            if piece and not piece.isascii():
                s, text, more = self.token(piece)
                state = max(state, s)
                if not s or more:
                    quiet += _cores(piece)
                piece = text
            out.append(piece)
        return state, "".join(out), quiet


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair = Repairer()
    for rb in batches:
        states, texts, tokens = [], [], []
        for line in rb.column(1).to_pylist():
            s, t, q = repair.line(line)
            states.append(s)
            texts.append(t if s else None)
            tokens.append(q)
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(states, pa.int32()), pa.array(texts, pa.string()), pa.array(tokens, pa.list_(pa.string())), rb.column(2)], names=["id", "state", "restored", "tokens", "key"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        out: list[tuple[str, str, str]] = []
        for token in rb.column(0).to_pylist():
            out += [(token, r.lower(), r) for r in quiet_readings(token)]
        cols = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["token", "reading", "text"])


def garbled(items: DataFrame, *, id_col: str = "item_id", line_col: str = "line", least: int = 3, times: int = 3) -> DataFrame:
    """``id``, ``state`` and ``restored`` of every garbled line.

    ``state`` is 1 if the whole line could be mapped back and 2 if part of it is lost; ``restored`` is the
    best text. A natural-looking token counts as garbled if another reading of it occurs at least
    ``least`` times in the collection and ``times`` times as often as the token, be it counted by
    occurrences or by distinct lines (copies of a garbled line don't make it natural). Tokens are pieces
    between blanks and their parts between separators. Null, empty and pure ASCII lines are never garbled.
    Ids may repeat; each row is judged by itself.
    """
    rows = items.where(F.col(line_col).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).alias("id"), F.col(line_col).alias("line"), F.xxhash64(line_col).alias("key"))
    seen = cut(rows.mapInArrow(_scan, f"id {dict(rows.dtypes)['id']}, state int, restored string, tokens array<string>, key bigint"))
    places = seen.select(F.explode("tokens").alias("token"), "key").groupBy("token", "key").agg(F.count("*").alias("n"))
    tokens = places.select("token").distinct().repartition(slots(items.sparkSession), "token")  # few bytes, much work
    terms = places.groupBy(F.lower("token").alias("reading"), "key").agg(F.sum("n").alias("n")).groupBy("reading").agg(F.sum("n").alias("usual"), F.count("*").alias("lines"))
    proposed = tokens.mapInArrow(_propose, "token string, reading string, text string").join(terms, "reading")
    same = terms.select(F.col("reading").alias("own"), F.col("usual").alias("own_n"), F.col("lines").alias("own_lines"))
    often = (F.col("usual") >= F.col("own_n") * times) | (F.col("lines") >= F.col("own_lines") * times)
    better = proposed.join(same, F.lower("token") == F.col("own")).where((F.col("usual") >= least) & often)
    better = better.groupBy("token").agg(F.max_by("text", F.struct("usual", "text")).alias("reading"))
    quiet = seen.where(F.size("tokens") > 0).select("id", F.explode("tokens").alias("token")).join(better, "token").groupBy("id").agg(F.collect_set(F.struct("token", "reading")).alias("swaps"))
    loud = seen.where("state > 0").select("id", "state", "restored")
    both = loud.join(quiet, "id", "full_outer")
    return both.select("id", F.coalesce("state", F.lit(1)).alias("state"), "restored", "swaps")


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair = Repairer()
    for rb in batches:
        out = []
        for line, restored, swaps in zip(*(rb.column(i).to_pylist() for i in (2, 3, 4))):
            if swaps:
                table = {s["token"]: s["reading"] for s in swaps}
                parts = []
                for p in _BLANKS.split(line):
                    core = p.strip(_EDGE)
                    if core in table:
                        parts.append(p.replace(core, table[core]))
                    elif any(c in table for c in _cores(p)):
                        for q in _INNER.split(p):
                            core = q.strip(_EDGE)
                            parts.append(q.replace(core, table[core]) if core in table else q if q.isascii() else repair.token(q)[1])
                    else:
                        parts.append(p if p.isascii() else repair.token(p)[1])
                restored = "".join(parts)
            out.append(line if restored is None else restored)
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(2), pa.array(out, pa.string())], names=["id", "state", "line", "restored"])


def repaired(items: DataFrame, *, id_col: str = "item_id", line_col: str = "line", **options) -> DataFrame:
    """``id``, ``state``, ``line`` and ``restored`` of every garbled line; see :func:`garbled`. Ids must be unique."""
    found = garbled(items, id_col=id_col, line_col=line_col, **options)
    rows = items.select(F.col(id_col).alias("id"), F.col(line_col).alias("line")).join(found, "id").select("id", "state", "line", "restored", "swaps")
    return rows.mapInArrow(_swap, f"id {dict(rows.dtypes)['id']}, state int, line string, restored string")
