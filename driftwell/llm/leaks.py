"""Evaluation items inside corpus documents: one automaton, one pass over every text.

The automaton holds the whole questions and answers, and pieces of the passages from every letter on, as letters and
digits only, so case, line ends, hyphens and punctuation don't matter. Its hits carry item and position, and are mapped
back to the words and signs of the original text. Passages with enough pieces in line are then followed word by word through
the whole text, through misread letters, broken and joined words, and over other columns' lines and adverts of any length,
and the longest run of successive words is measured.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate, chain
from math import prod

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.workers import once_per_process

PIECE = 10  #: letters of a piece; one starts at every letter of a passage
LETTERS = 14  #: letters that pieces in line must cover for a passage to be followed
BLOCK_BYTES = 1_000_000  #: wording in one automaton (some 200 bytes of memory a letter); more is searched in several passes
NEAR, SPAN = 125, 250  #: words of the text up to which a jump is judged by its cost alone, or by cost if what follows is FIRM; beyond, both sides must be SURE
#: Copies of a stretch expected by chance in the whole text: for following it, where half of the least run must be rarer, for looking around it and for joining it over any distance.
START, RARE, FIRM, SURE = 1e-2, 1e-3, 1e-5, 1e-9
EDGE, JUMP = 0.75, 2.25  #: cost in words of a jump between line parts, and of one elsewhere
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"[-¬‐­]\s*$")
CELL = re.compile(r"\n| {3,}")
#: Letters that print or scanning confuses (fixed values).
ALIKE = "ce co eo ao an nu un il ij i1 l1 lt tf s5 sf bh b6 b8 o0 rv ri g9 gq é6 èé êe éó db do hk 0c oc ec hb uu mn vy"
#: Letter groups read as one letter (fixed values).
GROUPS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("fi", "h"), ("iu", "m"))
_GROUPED = {(one, many) for many, one in GROUPS}
_TAKEN: dict[str, set[str]] = defaultdict(set)
for _a, _b in ((p[i], p[1 - i]) for p in ALIKE.split() for i in (0, 1)):
    _TAKEN[_a].add(_b)
_CHEAP = {(p[0], p[1]) for p in ALIKE.split()} | {(p[1], p[0]) for p in ALIKE.split()}


def normal(text: str) -> str:
    """Case folded, with signs that are misread letters inside words put back. Signs may grow (``ß``), none is dropped."""
    text = text.replace("İ", "i").casefold()
    if "!" in text or "(" in text or "|" in text:
        text = re.sub(r"[!|](?=[^\W_])", "l", text)
        text = re.sub(r"\((?=[^\W_])", "c", text)
    return text


def words(text: str) -> list[str]:
    """Runs of letters or digits."""
    return WORD.findall(normal(text))


def alike(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with misread letters: weighted edit distance up to a third of the word."""
    return a == b or (0.4 * abs(len(a) - len(b)) <= 0.34 * len(a) + 0.07 and _near(a, b))


def _costs_more(a: str, b: str, room: float) -> bool:
    """Whether the letters of ``a`` that ``b`` lacks cost more than ``room``, letter groups aside: 0.4 each at least where a letter that they are taken for is there, else 1."""
    total, there = 0.0, {*b}
    for x in {*a}:
        lacking = a.count(x) - b.count(x)
        if lacking > 0:
            total += lacking if there.isdisjoint(_TAKEN[x]) else 0.4 * lacking
    return total > room + 1e-9


_bits: dict[str, int] = defaultdict(lambda: 1 << len(_bits))


@lru_cache(200_000)
def _signature(word: str) -> tuple[int, int, int, int]:
    """As bits: its letters, those that these are taken for, and the ``GROUPS`` whose letters or whose one letter it has."""
    taken = {x for y in {*word} for x in _TAKEN[y]}
    return sum(_bits[c] for c in {*word}), sum(_bits[c] for c in taken), sum(1 << n for n, (many, _) in enumerate(GROUPS) if many in word), sum(1 << n for n, (_, one) in enumerate(GROUPS) if one in word)


@lru_cache(1_000_000)
def _near(a: str, b: str) -> bool:
    room = 0.34 * len(a) + 0.07
    own, own_taken, many, one = _signature(a)
    other, other_taken, other_many, other_one = _signature(b)
    lacking, added = own & ~other, other & ~own
    if lacking.bit_count() > 2 * room + 1:  # a letter that isn't there costs 0.4 at least
        return False
    if not (many & other_one or other_many & one):
        # As in ``_costs_more``, each letter counted once.
        if (lacking & ~other_taken).bit_count() + 0.4 * (lacking & other_taken).bit_count() > room or (added & ~own_taken).bit_count() + 0.4 * (added & own_taken).bit_count() > room:
            return False
        if _costs_more(a, b, room) or _costs_more(b, a, room):
            return False
    old: list[float] = []
    row: list[float] = list(range(len(b) + 1))
    before = ""
    for i, x in enumerate(a, 1):
        cur: list[float] = [i]
        left, least, y1 = i, i, ""
        for j, y in enumerate(b, 1):
            v = row[j - 1]
            if x != y:
                v += 0.4 if (x, y) in _CHEAP else 1
                if left + 1 < v:
                    v = left + 1
                if row[j] + 1 < v:
                    v = row[j] + 1
                if j > 1 and (x, y1 + y) in _GROUPED and row[j - 2] + 0.4 < v:
                    v = row[j - 2] + 0.4
                if i > 1 and (y, before + x) in _GROUPED and old[j - 1] + 0.4 < v:
                    v = old[j - 1] + 0.4
            cur.append(v)
            left, y1 = v, y
            if v < least:
                least = v
        if least > room and min(row) > room:
            return False
        old, row, before = row, cur, x
    return row[-1] <= room


def original_places(text: str, places: list[int]) -> list[int]:
    """Places in ``normal(text)`` as places in ``text``."""
    if not places:
        return places
    grown = {c: n - 1 for c in {*text} if c != "İ" and (n := len(c.casefold())) > 1}
    if not grown:
        return places
    starts = np.arange(len(text)) + np.cumsum([0, *(grown.get(c, 0) for c in text[:-1])])
    return (np.searchsorted(starts, places, "right") - 1).tolist()


class Passages:
    """The automaton over passages and whole strings (questions, answers), and what each of its entries stands for."""

    def __init__(self, texts: list[str], whole: list[str] = (), piece: int = PIECE) -> None:
        self.words = [words(t) for t in texts]
        self.at: list[dict[str, list[int]]] = []
        self.piece = piece
        #: Of every entry: (passage, offset of the piece, next word, letters up to it), and whole strings.
        entries: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            stream, begin = "".join(ws), [0, *accumulate(map(len, ws))]
            at: dict[str, list[int]] = defaultdict(list)
            for i, w in enumerate(ws):
                at[w].append(i)
            self.at.append(at)
            word = 0
            for o in range(len(stream) - piece + 1):
                while begin[word] < o:
                    word += 1
                if begin[word] < min(o + piece, len(stream)):
                    entries[stream[o : o + piece]].append((k, o, word, begin[word] - o))
        self.whole_words = [len(words(t)) for t in whole]
        self.whole: dict[int, list[int]] = defaultdict(list)
        number = {letters: n for n, letters in enumerate(entries)}
        for n, t in enumerate(whole):
            letters = "".join(words(t))
            if letters:
                entries[letters]  # noqa: B018 - an entry without pieces
                self.whole[number.setdefault(letters, len(number))].append(n)
        vocabulary = sorted({w for ws in self.words for w in ws})
        self.ids = {w: n for n, w in enumerate(vocabulary)}
        self.coded = [np.array([self.ids[w] for w in ws], np.int64) for ws in self.words]
        self.owner = np.repeat(np.arange(len(texts)), np.array([len(c) for c in self.coded], np.int64))
        #: For words side by side and one apart: their codes, and the places of each in the joined passages.
        self.pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.joined = joined = np.concatenate([*self.coded, np.zeros(0, np.int64)])
        self.begin = np.r_[0, np.cumsum([len(c) for c in self.coded], dtype=np.int64)]
        for d in (1, 2):
            at = np.flatnonzero(self.owner[:-d] == self.owner[d:]) if len(joined) > d else np.zeros(0, np.int64)
            codes, number, many = np.unique(joined[at] * (len(self.ids) + 1) + joined[at + d], return_inverse=True, return_counts=True)
            self.pairs.append((d, codes, np.r_[0, np.cumsum(many)], at[np.argsort(number, kind="stable")]))
        self.letters = np.array([len(e) for e in entries], np.int64)
        self.where = np.array([x for xs in entries.values() for x in xs], np.int64).reshape(-1, 4)
        self.first = np.r_[0, np.cumsum([len(xs) for xs in entries.values()], dtype=np.int64)]
        self.automaton = ahocorasick.Automaton()
        for n, letters in enumerate(entries):
            self.automaton.add_word(letters, n)
        if entries:
            self.automaton.make_automaton()

    def search(self, text: str, least: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
        """Passages with a run of at least ``least`` words, and whole strings: (number, words, first, end sign of the original text)."""
        folded = normal(text)
        toks = WORD.findall(folded)
        if not toks or not len(self.automaton):
            return [], []
        ids = np.array([self.ids.get(t, -1) for t in toks], np.int64)
        exact = self._exact(ids, least)
        if not exact and not self.whole:
            return [], []
        found = np.fromiter(chain.from_iterable(self.automaton.iter("".join(toks))), np.int64).reshape(-1, 2)
        if not len(found):
            return [], []
        end, entry = found[:, 0], found[:, 1]
        begin = np.r_[0, np.cumsum([len(t) for t in toks])]
        runs = self._runs(end, entry, begin, folded, toks, exact, least) if exact else []
        strings = []
        if self.whole:
            for e, n in zip(end.tolist(), entry.tolist(), strict=True):
                if n in self.whole:
                    a, z = (int(np.searchsorted(begin, x)) for x in (e + 1 - self.letters[n], e + 1))
                    if begin[a] == e + 1 - self.letters[n] and begin[z] == e + 1:  # whole words of the text
                        strings += [(w, self.whole_words[w], a, z - 1) for w in self.whole[n]]
        if not runs and not strings:
            return [], []
        spans = [m.span() for m in WORD.finditer(folded)]
        made = []
        for hits in (runs, strings):
            ends = original_places(text, [x for _, _, a, z in hits for x in (spans[a][0], spans[z][1] - 1)])
            made.append([(k, size, ends[2 * h], ends[2 * h + 1] + 1) for h, (k, size, _, _) in enumerate(hits)])
        return made[0], made[1]

    def _runs(self, end: np.ndarray, entry: np.ndarray, begin: np.ndarray, folded: str, toks: list[str], exact: dict[int, list[tuple[int, int]]], least: int) -> list[tuple[int, int, int, int]]:
        """(passage, run length, first word, last word of the text) of the passages with a run of ``least`` words."""
        many = self.first[entry + 1] - self.first[entry]
        row = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[entry], many)
        k = self.where[row, 0]
        able = np.zeros(len(self.words), bool)
        able[[*exact]] = True
        chosen = able[k]
        at, end, k = self.where[row[chosen]], np.repeat(end, many)[chosen], k[chosen]
        likely = self._in_line(k, at[:, 1], end) if len(k) else k
        if not len(likely):
            return []
        chosen = np.isin(k, likely)
        k, at, end = k[chosen], at[chosen], end[chosen]
        word = np.searchsorted(begin, end - self.piece + 1 + at[:, 3], "right") - 1
        layout, out = None, []
        for p in likely.tolist():
            own = k == p
            layout = layout or _Layout(folded, toks)
            hits = [(i, j) for i, j in {*zip(at[own, 2].tolist(), word[own].tolist(), strict=True)} if alike(self.words[p][i], toks[j])]
            run = _Follow(self.words[p], self.at[p], toks, layout).longest([*exact[p], *sorted(hits)], least)
            if run[0] >= least:
                out.append((p, *run))
        return out

    def _exact(self, text: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
        """The passages of which two thirds of the least run stand in stretches of exact words that are hardly chance, half of it in rarer ones, and the (passage word, text word) of these.

        Such a stretch has words side by side or one apart, at the same distance between passage and text.
        """
        n, size, total = len(text), len(self.ids) + 1, len(self.joined)
        rows = []
        for d, codes, first, places in self.pairs:
            if not len(codes) or n <= d:
                continue
            j = np.flatnonzero((text[:-d] >= 0) & (text[d:] >= 0))
            seen = text[j] * size + text[j + d]
            at = np.minimum(np.searchsorted(codes, seen), len(codes) - 1)
            known = codes[at] == seen
            at, j = at[known], np.repeat(j[known], many := (first[at + 1] - first[at])[known])
            w = places[np.arange(len(j)) + np.repeat(first[at] - (np.cumsum(many) - many), many)]
            rows += [(w, j), (w + d, j + d)]
        w, j = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 2
        if not len(w):
            return {}
        # One row per passage word and text word, ordered by shift and passage word.
        key = np.sort((j - w + total) * total + w)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        line = key // total
        w = key - line * total
        owner = self.owner[w]
        step = np.concatenate([[0], w[1:] - w[:-1]])
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (step[1:] > 2) | (owner[1:] != owner[:-1])])
        start = np.flatnonzero(new)
        sizes = np.diff(start, append=len(w))
        count = np.bincount(text + 1, minlength=size + 1)[1:]
        expected = np.add.reduceat(np.log(count / n, where=count > 0, out=np.zeros(len(count)))[self.joined[w]], start) + np.log(n)

        def having(chosen: np.ndarray, words: int) -> np.ndarray:
            """Whether so many of ``least`` successive words of each passage stand in the chosen rows' stretches."""
            there = np.zeros(total, bool)
            there[w[chosen]] = True
            there[w[chosen & (step == 2) & ~new] - 1] = True  # single words between
            place = np.flatnonzero(there)
            apart = place + self.owner[place] * least  # no window holds words of two passages
            out = np.zeros(len(self.words), bool)
            out[self.owner[place[np.searchsorted(apart, apart + least) - np.arange(len(apart)) >= words]]] = True
            return out

        rare = np.repeat(expected < np.log(START), sizes)
        enough = having(np.repeat(expected < np.log(RARE), sizes), least // 2)
        if enough.any():
            enough &= having(rare, least * 2 // 3)
        out: dict[int, list[tuple[int, int]]] = {p: [] for p in np.flatnonzero(enough).tolist()}
        keep = rare & enough[owner]
        for p, i, at in zip(owner[keep].tolist(), (w - self.begin[owner])[keep].tolist(), (line - total + w)[keep].tolist(), strict=True):
            out[p].append((i, at))
        return out

    def _in_line(self, k: np.ndarray, o: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The passages of which pieces at the same distance between passage and text (give or take a letter) cover ``LETTERS`` letters."""
        d = end - o
        order = np.lexsort((o, d, k))
        k, d, o = k[order], d[order], o[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
        adds = np.where(new, self.piece, np.minimum(np.r_[0, np.diff(o)], self.piece))
        start = np.flatnonzero(new)
        cover = np.add.reduceat(adds, start)
        k, d = k[start], d[start]
        beside = np.r_[(k[1:] == k[:-1]) & (d[1:] == d[:-1] + 1), False]
        both = cover + np.where(beside, np.r_[cover[1:], 0], 0)
        return np.unique(k[both >= LETTERS])


class _Layout:
    """For each word of a text: its line part, its place from the part's start and end, and whether it is broken off; how often each word occurs."""

    def __init__(self, folded: str, toks: list[str]) -> None:
        self.count = Counter(toks)
        self.first: list[int] = []
        self.last: list[int] = []
        self.broken: list[bool] = []
        pos = 0
        cuts = [m.span() for m in CELL.finditer(folded)] + [(len(folded), len(folded))]
        for a, b in cuts:
            part = folded[pos:a]
            n = len(WORD.findall(part))
            if n:
                self.first += range(n)
                self.last += range(n - 1, -1, -1)
                self.broken += [False] * (n - 1) + [bool(BREAK.search(part))]
            pos = b


class _Follow:
    """Runs of one passage in one text."""

    def __init__(self, passage: list[str], at: dict[str, list[int]], toks: list[str], layout: _Layout) -> None:
        self.p, self.at, self.t, self.y = passage, at, toks, layout

    def _ahead(self, i: int, j: int) -> tuple[int, int]:
        """(passage words, text words) matched from ``i``, ``j`` on, by the first rule that holds; (0, 0) if none."""
        p, t = self.p, self.t
        if i >= len(p) or j >= len(t):
            return 0, 0
        if alike(p[i], t[j]):
            return 1, 1
        if j + 1 < len(t) and len(t[j]) < len(p[i]) and abs(len(t[j]) + len(t[j + 1]) - len(p[i])) < 3 and alike(p[i], t[j] + t[j + 1]):
            return 1, 2
        if i + 1 < len(p) and len(t[j]) > len(p[i]) and abs(len(p[i]) + len(p[i + 1]) - len(t[j])) < 3 and alike(p[i] + p[i + 1], t[j]):
            return 2, 1
        if self.y.broken[j] and len(t[j]) > 1 and alike(p[i][: len(t[j])], t[j]):
            return 1, 1
        return 0, 0

    def _behind(self, i: int, j: int) -> tuple[int, int]:
        """As ``_ahead``, for the words that end with ``i``, ``j``."""
        p, t = self.p, self.t
        if i < 0 or j < 0:
            return 0, 0
        if alike(p[i], t[j]):
            return 1, 1
        if j > 0 and len(t[j]) < len(p[i]) and abs(len(t[j]) + len(t[j - 1]) - len(p[i])) < 3 and alike(p[i], t[j - 1] + t[j]):
            return 1, 2
        if i > 0 and len(t[j]) > len(p[i]) and abs(len(p[i]) + len(p[i - 1]) - len(t[j])) < 3 and alike(p[i - 1] + p[i], t[j]):
            return 2, 1
        if self.y.broken[j] and len(t[j]) > 1 and alike(p[i][: len(t[j])], t[j]):
            return 1, 1
        return 0, 0

    def _segments(self, exact: Iterable[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Unbroken stretches (passage from, to, text from, to; inclusive) with one of the exact words, by where they end in the text."""
        done: set[tuple[int, int]] = set()
        out = []
        for i, j in exact:
            if (i, j) in done:
                continue
            a, b = i, j
            while True:
                da, db = self._behind(a - 1, b - 1)
                if not da:
                    break
                a, b = a - da, b - db
                done.add((a, b))
            c, d = i + 1, j + 1
            while True:
                dc, dd = self._ahead(c, d)
                if not dc:
                    break
                done.add((c, d))
                c, d = c + dc, d + dd
            done.add((i, j))
            out.append((a, c - 1, b, d - 1))
        return sorted(set(out), key=lambda s: (s[3], s))

    def _chance(self, i0: int, i1: int) -> float:
        """How often passage words ``i0..i1`` are expected at one place of a text of the same words in any order; misread ones count as certain."""
        c, n = self.y.count, len(self.t)
        return prod(c[w] / n for w in self.p[i0 : i1 + 1] if w in c)

    def _most(self, stretches: list, least: int) -> int:
        """The most of ``least`` successive passage words that stand in any of the stretches (passage from, to, ...)."""
        size = len(self.p)
        inside = [0] * (size + 1)
        for i in {i for s in stretches for i in range(s[0], s[1] + 1)}:
            inside[i + 1] = 1
        before = list(accumulate(inside))
        return max(before[min(i + least, size)] - before[i] for i in range(size))

    def longest(self, pairs: list[tuple[int, int]], least: int) -> tuple[int, int, int]:
        """The longest run in the text: (passage words, first, last word of the text); zeros if it can't have ``least`` words.

        Stretches with one of the ``pairs`` (passage word, text word) are sought in the whole text, lone exact words only around those
        that are no chance. Two thirds of a run's words must be in such stretches.
        """
        n = len(self.t)
        firm = [s for s in self._segments(pairs) if self._chance(s[0], s[1]) * n < FIRM]
        if self._most(firm, least) < least * 2 // 3:
            return 0, 0, 0
        around = {j for s in firm for j in range(max(0, s[2] - NEAR), min(n, s[3] + NEAR + 1))}
        segs = self._segments([*pairs, *((i, j) for j in around for i in self.at.get(self.t[j], ()))])
        # Best chain ending with each stretch: net score, run start in the passage, first text word, chance.
        best: list[tuple[float, int, int, float]] = []
        by_end: dict[int, list[int]] = defaultdict(list)  # in order of the text
        top = (0, 0, 0)
        sure: list[tuple[int, int, int, int]] = []  # chains that are no chance: first text word, last, passage from, to
        for m1, (i0, i1, j0, j1) in enumerate(segs):
            own = self._chance(i0, i1)
            here = (float(i1 - i0 + 1), i0, j0, own)
            for cut in range(min(3, i1 - i0 + 1)):  # the stretch before may have run on by chance
                e = j0 + cut
                for m in reversed(by_end.get(i0 + cut - 1, ())):
                    gap = e - segs[m][3] - 1
                    if gap > SPAN:
                        break
                    if gap >= 0 and (gap <= NEAR or own * n < FIRM):
                        edge = gap == 0 or (self.y.last[segs[m][3]] <= 1 and self.y.first[min(e, j1)] <= 1)
                        score = best[m][0] + (i1 - i0 + 1 - cut) - (EDGE if edge else JUMP) - 0.002 * gap
                        if score > here[0]:
                            here = (score, best[m][1], best[m][2], best[m][3] * min(1.0, (gap + 1) * self._chance(i0 + cut, i1)))
            best.append(here)
            by_end[i1].append(m1)
            for back in (1, 2):  # and this one, too
                if i1 - back > i0:
                    by_end[i1 - back].append(m1)
            if i1 - here[1] + 1 > top[0]:
                top = (i1 - here[1] + 1, here[2], j1)
            sure += [(b, j1, a, i1) for a, b, chance in {here[1:], (i0, j0, own)} if chance * n < SURE]
        return self._joined(sure, top)

    def _joined(self, sure: list[tuple[int, int, int, int]], top: tuple[int, int, int]) -> tuple[int, int, int]:
        """The longest run when chains that are no chance are joined over any distance, or ``top`` if that is longer."""
        reach: dict[int, tuple[int, int]] = {}  # passage word -> the run that ends with it: least passage word, first text word
        waiting: list[tuple[int, int, int, int]] = []  # runs by their last text word
        for j0, j1, i0, i1 in sorted(sure):
            while waiting and waiting[0][0] < j0:
                _, end, a, b = heappop(waiting)
                for e in range(max(a, end - 2), end + 1):  # it may have run on by chance
                    reach[e] = min(reach.get(e, (a, b)), (a, b))
            a, b = min((reach[i] for i in range(i0 - 1, min(i0 + 2, i1)) if i in reach), default=(i0, j0))
            if a > i0:
                a, b = i0, j0
            if i1 - a + 1 > top[0]:
                top = (i1 - a + 1, b, j1)
            heappush(waiting, (j1, i1, a, b))
        return top


FOUND = "_whole boolean, _hash bigint, run_words int, first_char int, last_char int"


def find(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", whole: tuple[str, ...] = (), beside: tuple[str, ...] = (), least: int = 18, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, field, run_words, first_char, last_char)``: the documents and the fields of items that stand in them.

    A passage counts if at least ``least`` of its successive words stand in the text; ``run_words`` is the longest
    run's length. The strings in the columns ``whole`` (questions, answers) count if they stand in the text in full, word for word, once
    per place; those in ``beside`` (short answers, which stand in many texts anyway) only where another field of the item is found in the same document. ``first_char``, ``last_char`` are places in the original text (from 0, end exclusive). All items with the same passage or
    string are reported. Null and empty texts and strings, and passages shorter than ``least`` words,
    match nothing; rows repeated in either table match each. Rows with null ids are kept as such.

    The items are the stated query set; their strings are shipped to the workers in blocks of about ``block_bytes``, each block
    in one pass over the texts. What is found is joined with the items by string.
    """
    spark = docs.sparkSession
    doc_type = docs.schema[doc_id].dataType.simpleString()
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(c != passage).alias("whole"), F.col(c).cast("string").alias("s")) for c in (passage, *whole)))
    known = items.select(F.col(item_id).alias("item_id"), F.explode(fields).alias("_f")).select("item_id", "_f.field", F.col("_f.whole").alias("_w"), F.col("_f.s").alias("_s"), F.xxhash64("_f.s").alias("_h"))
    known = known.where(F.col("_s").isNotNull() & (F.trim("_s") != ""))
    distinct = known.select("_w", "_s", "_h").distinct()
    blocks = max(1, -(-int(distinct.agg(F.sum(F.octet_length("_s"))).first()[0] or 0) // block_bytes))
    schema = f"doc_id {doc_type}, {FOUND}"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for b in range(blocks):
        own = distinct.where(F.pmod("_h", F.lit(blocks)) == b).orderBy("_h").collect()
        shared = spark.sparkContext.broadcast(tuple([(r["_s"], r["_h"]) for r in own if r["_w"] == w] for w in (False, True)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            passages = once_per_process("passages", name, lambda: Passages(*([s for s, _ in part] for part in shared.value)))
            hashes = [[h for _, h in part] for part in shared.value]
            for batch in batches:
                found = []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        for w, hits in enumerate(passages.search(t, least)):
                            found += [(n, w == 1, hashes[w][k], *rest) for k, *rest in hits]
                if found:
                    at, w, h, *places = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(w), pa.array(h, pa.int64()), *(pa.array(c, pa.int32()) for c in places)], names=["doc_id", "_whole", "_hash", "run_words", "first_char", "last_char"])

        parts.append(rows.mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    joined = out.join(known, (F.col("_hash") == F.col("_h")) & (F.col("_whole") == F.col("_w")))
    found = joined.select("doc_id", "item_id", "field", "run_words", "first_char", "last_char")
    if not beside:
        return found
    other = F.max(~F.col("field").isin(*beside)).over(Window.partitionBy("doc_id", "item_id"))
    return found.withColumn("_other", other).where("_other").drop("_other")
