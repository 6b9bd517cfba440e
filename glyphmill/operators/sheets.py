"""Words of lines set against the words read off a composed sheet, which writes some of them joined or split.

A sheet's readings come in runs with a place each. A line takes the run that spells it best near where the line is
known to be; words left over take single readings, one reading for two words, or two readings for one. A reading is
given once, so a sheet is one group.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from glyphmill.functions.distances import likeness
from glyphmill.functions.grouped import each_group
from glyphmill.operators.boxes import _grams, _points, close_pairs

# What a pair of words scores by its likeness, what a step over one costs, the share of a line's words and the
# score that convince, what another region costs; and for what is left the least likeness of one word and of joined or split
# ones, and the least of it less the distance. Distances count in parts of how sure a line's place is.
SCORES, UNLIKE, STEP = ((1.0, 2.0), (0.75, 1.2), (0.6, 0.5)), -1.0, 0.8
PART_OF_LINE, CONVINCING, ELSEWHERE = 0.4, 0.6, 1.5
ONE, TWO, LEAST, SURE = 0.75, 0.8, 0.4, 1200.0
#: Texts of several sheets are set against each other at once while they take so many letters; so many pairs at a time, so
#: many cells of an alignment one by one, and letters of a text that fit a machine word.
TOGETHER, PAIRS, CELLS, BITS = 1 << 16, 1 << 16, 512, 64


def likes(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """likeness of each text of a to each of b, 0 where it is below least; those with ? or * one by one."""
    out = np.zeros((len(a), len(b)))
    i, j, d = close_pairs(a, b, 1 - least)
    own, size = np.array([len(t) for t in a], np.int64)[i], np.array([len(t) for t in b], np.int64)[j]
    out[i, j] = np.where((own > 0) & (size > 0), 1 - d / np.maximum(1, np.maximum(own, size)), 0.0)
    wild = lambda t: "?" in t or "*" in t
    marked = [j for j, t in enumerate(b) if wild(t)]
    for i, t in enumerate(a):
        for j in range(len(b)) if wild(t) else marked:
            out[i, j] = likeness(t, b[j])
    return out


def _edits(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Edit distances of texts p of x to texts q of y, whose letters are numbered; texts of x have 1 to BITS letters.

    A column of the distance table is two machine words (Myers, in Hyyrö's form), a step is taken for all pairs at once.
    """
    one = np.uint64(1)
    at = np.zeros((len(x), int(max(x.max(initial=0), y.max(initial=0))) + 2), np.uint64)  # the last is for -1, no letter
    for i in range(min(x.shape[1], BITS)):
        has = np.flatnonzero(nx > i)
        at[has, x[has, i]] |= one << np.uint64(i)
    up, down = np.full(len(p), ~np.uint64(0)), np.zeros(len(p), np.uint64)
    top, size, d = (nx[p] - 1).astype(np.uint64), ny[q], nx[p].copy()
    out = np.where(size == 0, d, 0)
    for j in range(int(size.max(initial=0))):
        same = at[p, y[q, j]]
        flat = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(flat | up), flat & up
        d += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        up, down = less | ~(flat | more), more & flat
        done = size == j + 1
        out[done] = d[done]
    return out


def close_in(groups: list[tuple[list[str], list[str]]], least: float) -> list[list[list[tuple[int, float]]]]:
    """likes of each group's own texts, as the places and values from least on for each text of a; many groups at once."""
    longest = max((len(t) for g in groups for s in g for t in s), default=0)
    if len(groups) > 1 and longest * sum(len(s) for g in groups for s in g) > TOGETHER:
        half = len(groups) // 2
        return close_in(groups[:half], least) + close_in(groups[half:], least)
    told = [[[] for _ in a] for a, _ in groups]
    if longest > BITS or (len(groups) == 1 and longest * sum(len(s) for s in groups[0]) > TOGETHER):
        for rows, (a, b) in zip(told, groups, strict=True):
            for k in range(0, len(a), BITS):  # a bounded block of texts against those of the group
                table = likes(a[k : k + BITS], b, least)
                for i, j in zip(*(c.tolist() for c in np.nonzero((table >= least) & (table > 0))), strict=True):
                    rows[k + i].append((j, float(table[i, j])))
        return told
    (na, x), (nb, y) = _points([t for a, _ in groups for t in a]), _points([t for _, b in groups for t in b])
    held, has, share = _grams(x), (_grams(y) > 0).astype(np.float32).T, 1 - least
    found, ends, k, m = [], [], 0, 0
    for a, b in groups:
        if a and b:
            own, size = na[k : k + len(a), None], nb[m : m + len(b)]
            longer = np.maximum(own, size)
            most = np.floor(share * longer + 1e-9)
            can = (held[k : k + len(a)] @ has[:, m : m + len(b)] >= longer - 1 - 2 * most) & (np.abs(own - size) <= most) & (own > 0) & (size > 0)
            i, j = np.nonzero(can)
            found.append((i + k, j + m))
        k, m = k + len(a), m + len(b)
        ends.append((k, m))
    if found:
        letters, flat = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
        shift = int(letters[0] < 0)  # what fills up a row stays -1
        u, v = flat[: x.size].reshape(x.shape) - shift, flat[x.size :].reshape(y.shape) - shift
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        d = np.concatenate([_edits(u, na, v, nb, i[n : n + PAIRS], j[n : n + PAIRS]) for n in range(0, len(i), PAIRS)] or [i])
        longer = np.maximum(na[i], nb[j])
        near = np.flatnonzero(d <= np.floor(share * longer + 1e-9))
        i, j, values = i[near], j[near], 1 - d[near] / longer[near]
        of = np.searchsorted([e for e, _ in ends], i, "right")
        firsts = np.array([(0, 0), *ends])[of]
        for n, i, j, v in zip(of.tolist(), (i - firsts[:, 0]).tolist(), (j - firsts[:, 1]).tolist(), values.tolist(), strict=True):
            if v >= least:
                told[n][i].append((j, v))
    wild = lambda t: "?" in t or "*" in t
    for rows, (a, b) in zip(told, groups, strict=True):
        marked = [j for j, t in enumerate(b) if wild(t)]
        for i, t in enumerate(a):
            if marked or wild(t):
                anew = range(len(b)) if wild(t) else marked
                skip = set(anew)
                rows[i] = sorted([r for r in rows[i] if r[0] not in skip] + [(j, v) for j in anew if (v := likeness(t, b[j])) >= least])
    return told


def aligned(alike: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The best local alignment over a table of likenesses (0 where a reading is taken): its score, and its pairs that are alike."""
    s = np.select([alike >= least for least, _ in SCORES], [v for _, v in SCORES], UNLIKE)
    if s.size <= CELLS:
        return _aligned_few(s.tolist())
    n, m = s.shape
    h = np.zeros((n + 1, m + 1))
    ramp = STEP * np.arange(m + 1)
    for i in range(n):
        base = np.maximum(0, np.append(0, np.maximum(h[i, :-1] + s[i], h[i, 1:] - STEP)))
        h[i + 1] = np.maximum(0, np.maximum.accumulate(base + ramp) - ramp)
    i, j = np.unravel_index(h.argmax(), h.shape)
    score, pairs = float(h[i, j]), []
    while h[i, j] > 1e-9:
        if math.isclose(h[i, j], h[i - 1, j - 1] + s[i - 1, j - 1], abs_tol=1e-9):
            i, j = i - 1, j - 1
            if alike[i, j] >= SCORES[-1][0]:
                pairs.append((int(i), int(j)))
        elif math.isclose(h[i, j], h[i - 1, j] - STEP, abs_tol=1e-9):
            i -= 1
        else:
            j -= 1
    return score, pairs[::-1]


def _aligned_few(s: list[list[float]]) -> tuple[float, list[tuple[int, int]]]:
    """aligned of a small table of scores, by the same sums one by one."""
    ramp = [STEP * j for j in range(len(s[0]) + 1 if s else 1)]
    h, top, i, j = [[0.0] * len(ramp)], 0.0, 0, 0
    for k, row in enumerate(s):
        old, run, new = h[k], 0.0, [0.0]
        for m, v in enumerate(row, 1):
            base, over = old[m - 1] + v, old[m] - STEP
            base = (base if base > over else over) if base > 0 or over > 0 else 0.0
            base += ramp[m]
            if base > run:
                run = base
            cell = run - ramp[m]
            new.append(cell if cell > 0 else 0.0)
            if cell > top:
                top, i, j = cell, k + 1, m
        h.append(new)
    pairs = []
    while h[i][j] > 1e-9:
        if math.isclose(h[i][j], h[i - 1][j - 1] + s[i - 1][j - 1], abs_tol=1e-9):
            i, j = i - 1, j - 1
            if s[i][j] > UNLIKE:
                pairs.append((i, j))
        elif math.isclose(h[i][j], h[i - 1][j] - STEP, abs_tol=1e-9):
            i -= 1
        else:
            j -= 1
    return top, pairs[::-1]


class Sheet:
    """lines: (line, words, (x, y, sure) or None, region); runs: (region, [(reading, text, x, y)]), both in order."""

    def __init__(self, lines: list[tuple], runs: list[tuple]):
        self.lines, self.runs = lines, runs
        self.got: dict[tuple[int, int], tuple[str, list, float, float]] = {}
        self.at = [(r, j) for r, (_, row) in enumerate(runs) for j in range(len(row))]
        self.first = np.cumsum([0, *(len(row) for _, row in runs)]).tolist()
        self.text = [runs[r][1][j][1] for r, j in self.at]
        self.free = [True] * len(self.at)
        self.own = list(dict.fromkeys(t for _, ws, *_ in lines for t in ws))

    def away(self, hint, x: float, y: float) -> float:
        return math.hypot(x - hint[0], y - hint[1]) / (hint[2] or SURE) if hint else 0.0

    def take(self, line: int, word: int, kind: str, at: list[int], part: tuple[float, float] = (0.0, 1.0)) -> None:
        self.got[line, word] = (kind, [self.runs[r][1][j][0] for r, j in (self.at[n] for n in at)], *part)
        for n in at:
            self.free[n] = False

    def runs_of_lines(self, like: list[list[tuple[int, float]]]) -> None:
        """Each line, those of most words first, takes its pairs with the run of the highest score less its distance; like tells what own texts are like."""
        self.like = dict(zip(self.own, like, strict=True))
        for k in sorted(range(len(self.lines)), key=lambda k: -len(self.lines[k][1])):
            _, words, hint, region = self.lines[k]
            # a run without a free reading that is like one of the words has no pairs to give
            some = defaultdict(list)
            for w, text in enumerate(words):
                for n, v in self.like[text]:
                    if self.free[n]:
                        some[self.at[n][0]].append((w, self.at[n][1], v))
            best = None
            for r in sorted(some):
                where, readings = self.runs[r]
                if len(words) * len(readings) <= CELLS:
                    table = [[UNLIKE] * len(readings) for _ in words]
                    for w, j, v in some[r]:
                        table[w][j] = next(score for least, score in SCORES if v >= least)
                    score, pairs = _aligned_few(table)
                else:
                    table = np.zeros((len(words), len(readings)))
                    for w, j, v in some[r]:
                        table[w, j] = v
                    score, pairs = aligned(table)
                if not pairs:
                    continue
                x = y = 0.0
                for _, j in pairs if hint else ():
                    x, y = x + readings[j][2], y + readings[j][3]
                value = score - (self.away(hint, x / len(pairs), y / len(pairs)) if hint else ELSEWHERE * (region is not None and where != region))
                if best is None or value > best[0]:
                    best = (value, r, pairs)
            if best and best[0] >= CONVINCING and len(best[2]) >= max(1, math.ceil(PART_OF_LINE * len(words))):
                for w, j in best[2]:
                    self.take(k, w, "whole", [self.first[best[1]] + j])

    def left(self) -> tuple[tuple[list[str], list[str]], tuple[list[str], list[str]]]:
        """What is left: words against two readings that follow each other, and two words against readings."""
        rest = [(t, ws[w + 1] if w + 1 < len(ws) and (k, w + 1) not in self.got else None) for k, (_, ws, *_) in enumerate(self.lines) for w, t in enumerate(ws) if (k, w) not in self.got]
        self.alone = [n for n, free in enumerate(self.free) if free] if rest else []
        self.twos = [n for n in self.alone if n + 1 < len(self.at) and self.at[n + 1][0] == self.at[n][0] and self.free[n + 1]]
        self.single = list(dict.fromkeys(t for t, _ in rest)) if self.twos else []
        self.double = list(dict.fromkeys(t + after for t, after in rest if after)) if self.alone else []
        return (self.single, [self.text[n] + self.text[n + 1] for n in self.twos]), (self.double, [self.text[n] for n in self.alone])

    def leftovers(self, split: list[list[tuple[int, float]]], join: list[list[tuple[int, float]]]) -> None:
        """Words that are left, in order: one reading for this and the next, one for this, or two neighbours for this; the likest and nearest."""
        halves, joined = dict(zip(self.single, split, strict=True)), dict(zip(self.double, join, strict=True))
        for k, (_, words, hint, _) in enumerate(self.lines):
            for w, text in enumerate(words):
                if (k, w) in self.got:
                    continue
                after = words[w + 1] if w + 1 < len(words) and (k, w + 1) not in self.got else None
                tries = [(v, "join", self.alone[n]) for n, v in joined.get(text + after, ()) if self.free[self.alone[n]]] if after else []
                tries += [(v, "whole", n) for n, v in self.like[text] if v >= ONE and self.free[n]]
                tries += [(v, "split", self.twos[n]) for n, v in halves.get(text, ()) if self.free[self.twos[n]] and self.free[self.twos[n] + 1]]
                value, kind, n = 0.0, "", 0
                for number, (v, how, m) in enumerate(tries):
                    r, j = self.at[m]
                    v -= self.away(hint, *self.runs[r][1][j][2:4])
                    if not number or v > value:
                        value, kind, n = v, how, m
                if value < LEAST:
                    continue
                if kind == "join":
                    cut = len(text) / (len(text) + len(after))
                    self.take(k, w, kind, [n], (0.0, cut))
                    self.take(k, w + 1, kind, [n], (cut, 1.0))
                else:
                    self.take(k, w, kind, [n, n + 1] if kind == "split" else [n])


def match_all(sheets: list[Sheet]) -> None:
    """What the words of each sheet got; texts of many sheets are compared at once."""
    for sheet, like in zip(sheets, close_in([(s.own, s.text) for s in sheets], SCORES[-1][0]), strict=True):
        sheet.runs_of_lines(like)
    rest = [s.left() for s in sheets]
    for sheet, split, join in zip(sheets, close_in([r[0] for r in rest], TWO), close_in([r[1] for r in rest], TWO), strict=True):
        sheet.leftovers(split, join)


def match_sheet(words: DataFrame, readings: DataFrame) -> DataFrame:
    """page, line, pos, readings, kind, first, last: for each word its readings, and which part of a reading that it shares.

    words(page, line, pos, text, x, y, sure, region) say where a line is known to be, or in which region, if that is
    known; readings(page, run, at, id, text, x, y, region) are in order of (run, at). kind is whole, join or split.
    Null texts are empty and like nothing; pages without words or readings give no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    id_kind = readings.schema["id"].dataType.simpleString()

    def held(left, right):
        def rows(cols, *by):
            names = list(cols)
            at = [names.index(n) for n in by]
            return sorted(zip(*cols.values(), strict=True), key=lambda r: [(r[i] is None, r[i] if r[i] is not None else 0) for i in at]), names.index

        (some, n), by_line = rows(left, "line", "pos"), defaultdict(list)
        line, pos, text, x, y, sure, region = (n(c) for c in ("line", "pos", "text", "x", "y", "sure", "region"))
        for r in some:
            by_line[r[line]].append(r)
        lines = [(k, [r[text] or "" for r in ws], (ws[0][x], ws[0][y], ws[0][sure]) if ws[0][x] is not None and ws[0][y] is not None else None, ws[0][region]) for k, ws in by_line.items()]
        places = [[r[pos] for r in ws] for ws in by_line.values()]
        (some, n), by_run = rows(right, "run", "at"), defaultdict(list)
        run, name, text, x, y, region = (n(c) for c in ("run", "id", "text", "x", "y", "region"))
        for r in some:
            by_run[r[run]].append(r)
        return Sheet(lines, [(rs[0][region], [(r[name], r[text] or "", r[x], r[y]) for r in rs]) for rs in by_run.values()]), places

    def each(groups):
        told = [held(*g) for g in groups]
        match_all([sheet for sheet, _ in told])
        return [[(sheet.lines[k][0], places[k][w], ids, kind, first, last) for (k, w), (kind, ids, first, last) in sorted(sheet.got.items())] for sheet, places in told]

    left, right = words.select("page", "line", "pos", "text", "x", "y", "sure", "region"), readings.select("page", "run", "at", "id", "text", "x", "y", "region")
    return each_group(left, right, "page", each, f"line {kinds['line']}, pos {kinds['pos']}, readings array<{id_kind}>, kind string, first double, last double", together=True)
