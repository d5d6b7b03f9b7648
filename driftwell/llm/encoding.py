"""Garbled text from wrong decoding: smoothed character models score every candidate chain.

Pass one counts the character trigrams of all records without certain damage (whole texts, numpy).
Pass two looks at each word with signs beyond ASCII: every chain of "was encoded in A, was decoded as B"
that applies is undone and scored; the likeliest result is accepted if it beats the word as it
stands by a margin that was validated on clean records and on artificially garbled ones.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.workers import once_per_process
from driftwell.session import by_key, stage

#: Encodings that text is taken for by mistake, and those it was really in (fixed values).
WRONG = ("cp1252", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "cp852", "mac_cyrillic", "iso8859_5")
RIGHT = ("cp1252", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "cp852", "mac_cyrillic", "iso8859_5")
MODEL_BYTES = 256 << 20  #: size of the model that is broadcast at most, 16 bytes a trigram; beyond it the rarest trigrams are told by their bigrams
DEPTH = 3  #: times a text may have been wrongly decoded
CAPITALS, MIXED, CHAIN = 2.0, 8.0, 1.5  #: log costs: word in capitals, change of script, chain
NEAR, REACH = 4, 500  #: words on either side, and signs of distance, that a single-byte chain must suit
FOREIGN = 6  #: letters of a script that a record has at least, if it has any
LENIENT = 1.0  #: gain at which a record is looked at again and no longer taken for clean
LEAST, MOST = 3.0, 16.0  #: bounds of the margin
DAMAGED = 0.03  #: share of damaged records that the margin is tuned for
WORD = re.compile(r"(?<![^ \t\r\n\f\v])[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\r\n\f\v]*+")
RUN = re.compile(r"[^\x00-\x7f]{2,}")
#: Signs that only wrong decoding leaves: the replacement sign and C1 controls.
CERTAIN = re.compile("[�\x80-\x9f]")
#: A sign inside a word that no script has there: such records are not taken for clean.
_INSIDE = re.compile("(?<=[a-zß-öø-ÿĀ-ſа-я])[¡-«®-¿×÷ʰ-Ͽ†-⿿ﬀ-﻿](?=[a-zß-öø-ÿĀ-ſа-я])")
_COMMON = re.compile("[\u00a0-ſΆ-ώЀ-џ‐-⁄€™\x80-\x9f]+")
_BITS = 21


@functools.cache
def _signs(enc: str) -> tuple[str, ...]:
    """The signs of bytes 128..255; a byte without sign is the control of its number."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@functools.cache
def _to_byte(enc: str) -> dict[int, int]:
    made = {ord(c): 128 + i for i, c in enumerate(_signs(enc))}
    for b in range(128, 160):
        made.setdefault(b, b)
    return made


@functools.cache
def _utf8_units(enc: str) -> re.Pattern[str]:
    """Runs of UTF-8 sequences, read in ``enc``."""
    inv: dict[int, list[str]] = {}
    for code, b in _to_byte(enc).items():
        inv.setdefault(b, []).append(chr(code))
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in inv.get(b, [])) + "]"
    cont = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{cont}|{cls(0xF0, 0xF4)}{cont}{cont}{cont})+")


def _undo_utf8(text: str, enc: str) -> str | None:
    """``text`` with all UTF-8 sequences that were read in ``enc`` decoded; null if there are none."""
    to = _to_byte(enc)

    def one(m: re.Match[str]) -> str:
        try:
            return bytes(to[ord(c)] for c in m[0]).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m[0]

    out = _utf8_units(enc).sub(one, text)
    return out if out != text else None


@functools.cache
def _any_unit() -> re.Pattern[str]:
    return re.compile("|".join(_utf8_units(e).pattern for e in WRONG))


@functools.lru_cache(200_000)
def _units(run: str) -> tuple[str, ...]:
    """The possible UTF-8 runs in a run of signs beyond ASCII."""
    return tuple(m[0] for m in _any_unit().finditer(run))


def _has_unit(text: str) -> bool:
    return any(_units(r) for r in RUN.findall(text))


@functools.lru_cache(200_000)
def _telling(unit: str) -> bool:
    """Whether a run that may be UTF-8 read wrongly holds signs that no word has, and makes common signs."""
    if unit.isalpha():
        return False
    for enc in WRONG:
        to = _to_byte(enc)
        if all(ord(c) in to for c in unit):
            try:
                if _COMMON.fullmatch(bytes(to[ord(c)] for c in unit).decode("utf-8")):
                    return True
            except UnicodeDecodeError:
                continue
    return False


def _clean(text: str) -> bool:
    """Whether nothing in the text is certain or likely to be damage; only such records train the model."""
    return not (CERTAIN.search(text) or _INSIDE.search(text) or any(_telling(u) for r in RUN.findall(text) for u in _units(r)))


@functools.cache
def _swap(right: str, wrong: str) -> dict[int, str]:
    """For single bytes of ``right`` that were read in ``wrong``: the sign seen to the sign meant."""
    signs = _signs(right)
    return {code: signs[b - 128] for code, b in _to_byte(wrong).items() if signs[b - 128] != chr(code)}


_PAIRS = tuple((right, wrong) for right in RIGHT for wrong in WRONG if right != wrong)


@functools.lru_cache(20_000)
def _meant(code: int) -> tuple[int, ...]:
    """What a sign was meant to be by each of the ``_PAIRS``; -1 where that is certain damage."""
    return tuple(code if (t := _swap(*pair).get(code)) is None else -1 if CERTAIN.match(t) else ord(t) for pair in _PAIRS)


@functools.lru_cache(5_000)
def _mappings(signs: tuple[int, ...]) -> tuple[tuple[str, dict[int, str], dict[int, int]], ...]:
    """What the single-byte chains make of some signs: name, whole table and codes of the first chain for each different result, without results that are certain damage."""
    made: dict[tuple[int, ...], tuple[str, str]] = {}
    for pair, meant in zip(_PAIRS, zip(*map(_meant, signs), strict=True), strict=True):
        if meant not in made and meant != signs and -1 not in meant:
            made[meant] = pair
    return tuple((f"{right}>{wrong}", _swap(right, wrong), dict(zip(signs, meant, strict=True))) for meant, (right, wrong) in made.items())


def garble(text: str, right: str, wrong: str) -> str:
    """``text`` encoded in ``right`` and decoded in ``wrong`` (for validation); signs it lacks become ``?``."""
    raw = text.encode(right, "replace")
    signs = _signs(wrong)
    return "".join(chr(b) if b < 128 else signs[b - 128] for b in raw)


# -- the model ------------------------------------------------------------------------------------


_PART = np.array([-1], np.int64)


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a = np.where((a == 10) | (a == 9) | (a == 13), 32, a)
    return a[(a != 32) | (np.r_[0, a[:-1]] != 32)] if len(a) else a


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the clean records with their counts."""
    plain, made = np.zeros(1 << 21, np.int64), {}
    held: list[np.ndarray] = []

    def fold() -> None:
        if not held:
            return
        c = np.concatenate(held)
        held.clear()
        x, y, z = c[:-2], c[1:-1], c[2:]
        whole = (x >= 0) & (y >= 0) & (z >= 0)  # records are parted by -1
        x, y, z = x[whole], y[whole], z[whole]
        low = (x | y | z) < 128
        np.add(plain, np.bincount((x << 14 | y << 7 | z)[low], minlength=1 << 21), out=plain)
        k, n = np.unique((x << 2 * _BITS | y << _BITS | z)[~low], return_counts=True)
        for code, times in zip(k.tolist(), n.tolist(), strict=True):
            made[code] = made.get(code, 0) + times

    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and _clean(text):
                c = _codes(f" {text} ")
                held += [c, _PART]
                size += len(c)
                if size > 3_000_000:
                    fold()
                    size = 0
    fold()
    at = np.flatnonzero(plain)
    code = np.r_[(at >> 14) << 2 * _BITS | (at >> 7 & 127) << _BITS | at & 127, np.array(list(made), np.int64)].astype(np.int64)
    n = np.r_[plain[at], np.array(list(made.values()), np.int64)].astype(np.int64)
    for i in range(0, len(code), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(code[i : i + 50_000]), pa.array(n[i : i + 50_000])], names=["gram", "n"])


@dataclass
class CharModel:
    """Interpolated trigram model; ``code``/``n`` are the trigrams kept and their counts."""

    code: np.ndarray
    n: np.ndarray
    margin: float = 0.0

    def build(self) -> Model:
        return Model(self)


class Model:
    """A ``CharModel`` with its dictionaries, for scoring in a worker."""

    def __init__(self, kept: CharModel) -> None:
        self.margin = kept.margin
        mask = (1 << _BITS) - 1
        x, y, z = kept.code >> 2 * _BITS, kept.code >> _BITS & mask, kept.code & mask
        self.tri = dict(zip(kept.code.tolist(), kept.n.tolist(), strict=True))
        self.ctx = self._sum(x << _BITS | y, kept.n)
        self.bi = self._sum(y << _BITS | z, kept.n)
        self.mid = self._sum(y, kept.n)
        self.uni = self._sum(z, kept.n)
        self.total = max(int(kept.n.sum()), 1)
        self.seen: dict[str, tuple[float, str, str]] = {}
        self.scores: dict[str, float] = {}
        self._memo: dict[int, float] = {}

    @staticmethod
    def _sum(keys: np.ndarray, n: np.ndarray) -> dict[int, int]:
        k, at = np.unique(keys, return_inverse=True)
        return dict(zip(k.tolist(), np.bincount(at, weights=n, minlength=len(k)).astype(np.int64).tolist(), strict=True)) if len(k) else {}

    def p(self, c: int) -> float:
        return (self.uni.get(c, 0) + 0.01) / (self.total + 1000)

    def lp(self, a: int, b: int, c: int) -> float:
        key = a << 2 * _BITS | b << _BITS | c
        v = self._memo.get(key)
        if v is None:
            ab, bc = self.ctx.get(a << _BITS | b, 0), self.bi.get(b << _BITS | c, 0)
            t, m = self.tri.get(key, 0), self.mid.get(b, 0)
            p1 = self.p(c)
            p2 = (bc + 2 * p1) / (m + 2)
            v = math.log((t + 3 * p2) / (ab + 3))
            if len(self._memo) > 500_000:
                self._memo.clear()
            self._memo[key] = v
        return v

    def _raw(self, word: str) -> float:
        c = [32, 32, *map(ord, word), 32]
        total = self._first(c[2])
        for i in range(3, len(c)):
            total += self.lp(c[i - 2], c[i - 1], c[i])
        return total

    def score(self, word: str) -> float:
        """Log-likelihood of the word between spaces; words in capitals count as in small letters, mixed scripts cost."""
        v = self.scores.get(word)
        if v is None:
            v = self._raw(word)
            if word.isupper() and sum(map(str.isalpha, word)) > 1:
                v = max(v, self._raw(word.lower()) - CAPITALS)
            kinds = [k for c in word if c.isalpha() for k in (_script(ord(c)),)]
            v -= MIXED * sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
            if len(self.scores) > 200_000:
                self.scores.clear()
            self.scores[word] = v
        return v

    def _first(self, c: int) -> float:
        p1 = self.p(c)
        return math.log((self.bi.get(32 << _BITS | c, 0) + 2 * p1) / (self.mid.get(32, 0) + 2))

    def _single(self, word: str, stands: float, least: float) -> tuple[float, str, str]:
        """The likeliest of all single-byte chains of a word, if it gains more than ``least``: gain, name and text.

        Only the trigrams with changed signs can gain, and the script changes that vanish. A chain is given up as soon as it
        can't gain enough by these; the others are scored in full.
        """
        top, lp = (least, "", word), self.lp
        codes = [32, 32, *map(ord, word), 32]
        signs = tuple(sorted({c for c in codes if c > 127}))
        at = sorted({k for i, c in enumerate(codes) if c > 127 for k in (i, i + 1, i + 2) if k < len(codes)})
        windows = [(codes[i - 2], codes[i - 1], codes[i]) for i in at]
        starts = at[0] == 2  # the first sign stands after a space only
        own = self._first(windows[0][2]) if starts else lp(*windows[0])
        for w in windows[1:]:
            own += lp(*w)
        scripts = [k for c in word if c.isalpha() for k in (_script(ord(c)),)]
        room = MIXED * sum(x != y for x, y in zip(scripts, scripts[1:], strict=False)) - CHAIN
        plain = any(c.islower() for c in word)
        for name, table, to in _mappings(signs):
            if plain:
                need = top[0] + own - room
                x, y, z = windows[0]
                total = self._first(to.get(z, z)) if starts else lp(to.get(x, x), to.get(y, y), to.get(z, z))
                for x, y, z in windows[1:]:
                    if total <= need:
                        break
                    total += lp(to.get(x, x), to.get(y, y), to.get(z, z))
                if total <= need:
                    continue
            t = word.translate(table)
            gain = self.score(t) - stands - CHAIN
            if gain > top[0]:
                top = (gain, name, t)
        return top

    def undone(self, word: str, depth: int = DEPTH) -> Iterator[tuple[str, str]]:
        """The UTF-8 chains that apply, undone, up to ``depth`` deep: (name, text)."""
        done = set()
        for enc in WRONG:
            t = _undo_utf8(word, enc)
            if t is not None and t not in done:
                done.add(t)
                yield f"utf_8>{enc}", t
                if depth > 1 and _has_unit(t):
                    for name, deeper in self.undone(t, depth - 1):
                        yield f"{name}|utf_8>{enc}", deeper

    def _rarest(self, word: str) -> int:
        """The least common sign beyond ASCII (0: none); a printer's hyphen at the end proves nothing."""
        return min((ord(c) for c in (word[:-1] if word.endswith("¬") else word) if ord(c) > 127), key=self.p, default=0)

    def judge(self, word: str) -> tuple[float, str, str]:
        """The likeliest undone chain of a word: its gain over the word as it stands, name and text."""
        if word in self.seen:
            return self.seen[word]
        top = (0.0, "", word)
        stands = self.score(word)
        for name, t in self.undone(word) if _has_unit(word) else ():
            gain = self.score(t) - stands - CHAIN * (1 + name.count("|"))
            if gain > top[0]:
                top = (gain, name, t)
        single = self._single(word, stands, max(top[0], LENIENT))
        if single[1]:
            top = single
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[word] = top
        return top

    def accepted(self, text: str, margin: float | None = None) -> list[tuple[int, int, str, str, float]]:
        """The words of a text to be restored: (start, end, chain, restored, gain of the surroundings).

        A chain through UTF-8 leaves sequences of its own, so a word can prove it. A chain between single bytes must
        also suit the nearest words with the same telling sign: their gains are added up. Where it does, the words
        around that gain by it are restored, too.
        """
        margin = self.margin if margin is None else margin
        if not any((seen.get(w) or self.judge(w))[0] >= margin for seen in (self.seen,) for w in _words(text)):
            return []
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        out, single = [], {}
        for i, (lo, hi, w) in enumerate(words):
            gain, name, t = self.seen.get(w) or self.judge(w)
            if gain < margin:
                continue
            if name.startswith("utf_8"):
                out.append((lo, hi, name, t, gain))
            else:
                single.setdefault((name, chr(self._rarest(w))), []).append(i)
        for (name, sign), hits in single.items():
            table = _swap(*name.split(">"))
            gain_of = lambda i: self.score(words[i][2].translate(table)) - self.score(words[i][2])  # noqa: B023, E731
            same = [i for i, (_, _, w) in enumerate(words) if sign in w]
            gains = {i: gain_of(i) for i in same}
            at = {i: k for k, i in enumerate(same)}
            taken: dict[int, float] = {}
            for i in hits:
                around = [j for j in same[max(0, at[i] - NEAR) : at[i] + NEAR + 1] if abs(words[j][0] - words[i][0]) <= REACH]
                total = sum(gains[j] for j in around)
                if total >= margin and 2 * sum(gains[j] > 0 for j in around) > len(around):
                    for j in {*around, *range(max(0, i - NEAR), min(len(words), i + NEAR + 1))}:
                        if (gains[j] if j in gains else gain_of(j)) > 0.25 * margin:
                            taken[j] = max(taken.get(j, 0.0), total)
            out += [(*words[j][:2], name, words[j][2].translate(table), g) for j, g in taken.items()]
        out.sort(key=lambda x: (x[0], -x[4]))
        out = [x for k, x in enumerate(out) if not k or x[0] != out[k - 1][0]]
        # Letters of another script must not be the only ones of the record.
        strange = {k: _other(x[3]) for k, x in enumerate(out)}
        if any(strange.values()):
            known = _other(text) + sum(strange.values())
            out = [x for k, x in enumerate(out) if not strange[k] or known >= FOREIGN]
        return out


def _words(text: str) -> list[str]:
    """The words that ``WORD`` finds."""
    for c in "\t\r\n\f\v":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if not w.isascii()]


def _other(text: str) -> int:
    return sum(0x370 <= ord(c) < 0x530 for c in text)


def _script(code: int) -> int:
    return 1 if code < 0x250 or 0x1E00 <= code < 0x1F00 else 2 if 0x400 <= code < 0x530 else 3 if 0x370 <= code < 0x400 else 4


def _grams(docs: DataFrame, text: str) -> DataFrame:
    """``(gram, n)``: trigram counts."""
    return docs.select(text).mapInArrow(_count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _kept(grams: DataFrame, model_bytes: int) -> CharModel:
    kept = grams.where("n > 0").orderBy(F.desc("n"), "gram").limit(max(model_bytes // 16, 1)).toPandas()
    return CharModel(kept["gram"].to_numpy(np.int64), kept["n"].to_numpy(np.int64))


_STEPS = np.arange(LEAST, MOST + 0.5, 0.5)
_CHAINS = [("utf-8", w) for w in WRONG[:2]] + [(r, w) for r in RIGHT[:7] for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251") if r != w]


def tried(m: Model, text: str, number: int) -> tuple[float, float | None]:
    """What a record gains at most as it stands, and what with one short stretch garbled; none if that changes nothing.

    Chain and stretch follow from the record's ``number``, each in turn.
    """
    alarm = max((x[4] for x in m.accepted(text, LENIENT)), default=0.0)
    words = [w.start() for w in WORD.finditer(text)]
    if not words:
        return alarm, None
    right, wrong = _CHAINS[number % len(_CHAINS)]
    at = words[number // len(_CHAINS) % len(words)]
    stretch = text[at : at + 60]
    bad = garble(stretch, right, wrong)
    if bad == stretch or "?" in bad[: len(stretch)].replace(stretch, ""):
        return alarm, None
    return alarm, max((x[4] for x in m.accepted(text[:at] + bad + text[at + 60 :], LENIENT) if at - 5 <= x[0] <= at + len(bad)), default=0.0)


def validated_margin(tallies: Iterable[tuple[bool, int, int]]) -> float:
    """The margin of least expected error, from how many records (garbled or not) gain up to how many of the ``_STEPS``: (garbled, steps, records)."""
    counts = np.zeros((2, len(_STEPS) + 1))
    for garbled, steps, n in tallies:
        counts[int(garbled), steps] += n
    stand, garbled = counts.sum(1)
    if not stand or not garbled:
        return (LEAST + MOST) / 4
    false = 1 - np.cumsum(counts[0])[:-1] / stand
    missed = np.cumsum(counts[1])[:-1] / garbled
    return float(_STEPS[int(np.argmin((1 - DAMAGED) * false + DAMAGED * missed))])


def train(docs: DataFrame, text: str = "text", *, model_bytes: int = MODEL_BYTES, validation: int | None = None) -> tuple[CharModel, DataFrame]:
    """The character model of the clean records, with a validated margin, and the records to be looked at.

    The trigrams of whole texts are counted over all records without certain damage. With that model every record is
    read once more; those where any word gains by any chain are staged, and their counts are taken out again, so the final
    model has learnt from clean records only. The margin is validated with the final model on all records that are clean as far
    as is known: false alarms are counted on them as they stand, misses with one short stretch garbled. ``model_bytes`` bounds the model; ``validation``
    restricts that last count to so many records, the least by hash. The staged records keep all columns.
    """
    grams = stage(_grams(docs, text))
    spark, own = docs.sparkSession, uuid.uuid4().hex
    first = spark.sparkContext.broadcast(_kept(grams, model_bytes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once_per_process("encoding", own + "first", lambda: first.value.build())
        for batch in batches:
            keep = [bool(t) and not t.isascii() and (bool(CERTAIN.search(t)) or bool(m.accepted(t, LENIENT))) for t in batch.column(text).to_pylist()]
            if any(keep):
                yield batch.filter(pa.array(keep))

    hashed = docs.withColumn("_h", F.xxhash64(text))
    doubtful = stage(hashed.mapInArrow(look, hashed.schema))
    left = grams.unionByName(_grams(doubtful, text).select("gram", (-F.col("n")).alias("n"))).groupBy("gram").agg(F.sum("n").alias("n"))
    model = _kept(left, model_bytes)
    final = spark.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once_per_process("encoding", own + "final", lambda: final.value.build())
        counts = np.zeros((2, len(_STEPS) + 1), np.int64)
        for batch in batches:
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and not t.isascii() and _clean(t):
                    for garbled, gain in enumerate(tried(m, t, h)):
                        if gain is not None:
                            counts[garbled, np.searchsorted(_STEPS, gain, "right")] += 1
        garbled, steps = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(garbled == 1), pa.array(steps, pa.int32()), pa.array(counts[garbled, steps])], names=["garbled", "steps", "n"])

    rows = hashed.select(text, "_h")
    if validation is not None:
        rows = rows.where(F.col(text).rlike(r"[^\x00-\x7f]")).orderBy("_h").limit(validation)
    model.margin = validated_margin(map(tuple, rows.mapInArrow(tally, "garbled boolean, steps int, n bigint").groupBy("garbled", "steps").agg(F.sum("n")).collect()))
    # The files follow the table's; the work is spread by hash.
    return model, by_key(doubtful, "_h").select(*docs.columns)


def repair(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model_bytes: int = MODEL_BYTES, validation: int | None = None) -> DataFrame:
    """``(doc_id, chains, n_spans, n_lost, restored)``: records with wrongly decoded signs, and their text as far as it can be restored.

    ``chains`` names each accepted chain (``right>wrong``, the innermost first), ``n_spans`` counts words restored, ``n_lost``
    replacement signs and C1 controls that no chain explains. Null and empty texts are never found. Rows
    with a null id come out with a null id; repeated rows come out each. An empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model, docs = train(docs, "text", model_bytes=model_bytes, validation=validation)
    shared, own = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, chains array<string>, n_spans int, n_lost int, restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once_per_process("encoding", own, lambda: shared.value.build())
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                found: dict[str, int] = {}
                parts, last = [], 0
                hits = m.accepted(t)
                for lo, hi, name, restored, _ in hits:
                    found[name] = found.get(name, 0) + 1
                    parts += [t[last:lo], restored]
                    last = hi
                spans, out = len(hits), "".join(parts) + t[last:]
                lost = len(CERTAIN.findall(out))
                if spans or lost:
                    rows.append((i, sorted(found, key=lambda k: (-found[k], k)), spans, lost, out))
            if rows:
                at, chains, spans_, lost_, out_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(chains, pa.list_(pa.string())), pa.array(spans_, pa.int32()), pa.array(lost_, pa.int32()), pa.array(out_)], names=["doc_id", "chains", "n_spans", "n_lost", "restored"])

    return docs.mapInArrow(run, schema)
