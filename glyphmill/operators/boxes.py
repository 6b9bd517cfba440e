"""Which box of a page is which word: runs along lines, what lies between, leftovers; and boxes for another reading's words.

Matching is greedy and works on what the best run has left, so a page is one group: its words, its boxes, and the pairs
of them that read alike. `transfer_by_glyphs` is relational; only the alignment of two readings of a line is a function
of that line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.glyphs import glyph_map
from glyphmill.functions.grouped import each_group
from glyphmill.functions.shipping import ship, spread

# What a pair scores by its share of edits, what a step over a word or box costs, and distances on the
# page: how far a word may be from where its line runs, from its neighbouring lines, and (in heights) from the word before.
EXACT, NEAR, CLOSE, NEAR_SHARE, CLOSE_SHARE, GAP = 3.0, 2.0, 1.0, 0.2, 0.34, 1.0
REACH, FAR_AWAY, JUMP = 120.0, 600.0, 9
#: Boxes more than words that may be filled in between two placed words; lines before and after that tell where a line is.
SPARE, AROUND = 3, 3
#: The least part of a word that another reading's box takes from it, and what counts as all of it.
SLIVER, START, END = 0.15, 0.05, 0.95
#: Pairs of neighbouring letters are told apart by so many hashes.
GRAMS = 1024
#: Up to so many points a run is found without arrays.
FEW = 24


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of every text of a to every text of b, all pairs a letter at a time."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(a + b))))}
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    put = lambda rows, n: np.array([[letters[c] for c in r] + [-1] * (n - len(r)) for r in rows]).reshape(len(rows), n)
    x, y = put(a, max(na, default=0)), put(b, max(nb, default=0))
    place = np.arange(y.shape[1] + 1)
    row = np.broadcast_to(place, (len(a), len(b), len(place))).astype(np.int32)
    out = np.where(na[:, None] == 0, nb[None, :], 0)
    at = np.minimum(nb, len(place) - 1)
    for i in range(x.shape[1]):
        swap = row[:, :, :-1] + (x[:, i, None, None] != y[None, :, :])
        new = np.concatenate([np.full((*row.shape[:2], 1), i + 1), np.minimum(row[:, :, 1:] + 1, swap)], axis=2)
        row = np.minimum.accumulate(new - place, axis=2) + place
        done = na == i + 1
        out[done] = row[done][:, np.arange(len(b)), at]
    return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of texts, and their code points in rows that end in -1."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return size, out


def _grams(x: np.ndarray) -> np.ndarray:
    """How often each text has each pair of neighbouring letters, by hash."""
    pair = (x[:, :-1] >= 0) & (x[:, 1:] >= 0)
    g = (x[:, :-1] * 31 + x[:, 1:])[pair] % GRAMS
    return np.bincount(np.nonzero(pair)[0] * GRAMS + g, minlength=GRAMS * len(x)).reshape(len(x), GRAMS).astype(np.float32)


def close_pairs(a: list[str], b: list[str], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j, edits) of a text of a and one of b whose edits are at most share of the longer's letters.

    An edit touches two neighbouring pairs of letters at most, so texts that share too few of these are further apart
    and needn't be set against each other; the others are, a letter at a time.
    """
    (na, x), (nb, y) = _points(a), _points(b)
    held, has = _grams(x), (_grams(y) > 0).astype(np.float32).T
    told = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(a), 64):  # a bounded block of texts against those of the page
        longer = np.maximum(na[k : k + 64, None], nb)
        most = np.floor(share * longer + 1e-9).astype(np.int64)
        can = (held[k : k + 64] @ has >= longer - 1 - 2 * most) & (np.abs(na[k : k + 64, None] - nb) <= most)
        i, j = np.nonzero(can)
        for m in range(0, len(i), 4096):
            p, q = i[m : m + 4096], j[m : m + 4096]
            d = np.zeros(len(p), np.int64)
            w = min(x.shape[1], y.shape[1])
            unlike = np.flatnonzero((na[p + k] != nb[q]) | (x[p + k, :w] != y[q, :w]).any(axis=1))
            d[unlike] = _edits_of(x[p[unlike] + k], na[p[unlike] + k], y[q[unlike]], nb[q[unlike]])
            near = d <= most[p, q]
            told.append((p[near] + k, q[near], d[near]))
    i, j, d = (np.concatenate(c) for c in zip(*told, strict=True))
    return i, j, d


def _edits_of(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Edit distances of rows of letters, each of x to its own of y."""
    y = y[:, : int(ny.max(initial=0))]
    place = np.arange(y.shape[1] + 1)
    row = np.broadcast_to(place, (len(x), len(place)))
    out = np.where(nx == 0, ny, 0)
    for i in range(int(nx.max(initial=0))):
        new = np.empty((len(x), len(place)), np.int64)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (x[:, i, None] != y), out=new[:, 1:])
        row = np.minimum.accumulate(new - place, axis=1) + place
        done = np.flatnonzero(nx == i + 1)
        out[done] = row[done, ny[done]]
    return out


def scores(words: list[str], boxes: list[str]) -> dict[int, list[tuple[int, float]]]:
    """For each word the boxes that read alike, in order, with their scores; texts are compared once each."""
    a, b = list(dict.fromkeys(words)), list(dict.fromkeys(boxes))
    where = defaultdict(list)
    for k, t in enumerate(boxes):
        where[t].append(k)
    found: dict[str, list] = {t: [] for t in a}
    for i, j, d in zip(*(c.tolist() for c in close_pairs(a, b, CLOSE_SHARE)), strict=True):
        share = d / max(1, len(a[i]), len(b[j]))
        if share <= CLOSE_SHARE:
            found[a[i]] += [(x, EXACT if d == 0 else NEAR if share <= NEAR_SHARE else CLOSE) for x in where[b[j]]]
    for near in found.values():
        near.sort()
    return {k: found[t] for k, t in enumerate(words)}


def best_chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The run of points (word, box, score), both rising, with the highest score less GAP for each word or box between.

    It is a local alignment over the pairs that read alike: setting two unlike texts against each other costs no less
    than leaving both out. Of equal ends the first counts; of equal ways back the nearest.
    """
    points = sorted(points)
    if len(points) <= FEW:
        return _best_of_few(points)
    i, j, s = (np.array(c, float) for c in zip(*points, strict=True))
    best, back = s.copy(), np.full(len(points), -1)
    for k in range(1, len(points)):
        can = np.flatnonzero((i[:k] < i[k]) & (j[:k] < j[k]))
        if len(can):
            ways = best[can] - GAP * ((i[k] - i[can] - 1) + (j[k] - j[can] - 1))
            at = len(ways) - 1 - int(ways[::-1].argmax())
            if ways[at] > 0:
                best[k] += ways[at]
                back[k] = can[at]
    k, out = int(best.argmax()), []
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def _best_of_few(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """best_chain of sorted points, one by one."""
    best, back = [p[2] for p in points], [-1] * len(points)
    for k, (i, j, _) in enumerate(points):
        top = 0.0
        for c in range(k):
            p = points[c]
            if p[0] < i and p[1] < j:
                way = best[c] - GAP * ((i - p[0] - 1) + (j - p[1] - 1))
                if way > 0 and way >= top:
                    top, back[k] = way, c
        best[k] += top
    k, out = best.index(max(best)), []
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def _grown(word: str, boxes: list[str]) -> list[int]:
    """Edits of word to the first box, the first two set together, and so on: one table that grows a letter at a time."""
    row, out = list(range(len(word) + 1)), []
    for box in boxes:
        for y in box:
            over, row[0] = row[0], row[0] + 1
            for i, x in enumerate(word, 1):
                over, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, over + (x != y))
        out.append(row[-1])
    return out


def shared_out(boxes: list[str], words: list[str]) -> list[int]:
    """How many of the boxes, in order, each word gets, one at least, so that their texts set together differ least from the words."""
    n = len(boxes)
    cost, came = {0: 0}, []
    for k, word in enumerate(words):
        new, via = {}, {}
        for p in cost:
            for q, d in enumerate(_grown(word, boxes[p : n - (len(words) - k - 1)]), p + 1):
                if q not in new or cost[p] + d < new[q]:
                    new[q], via[q] = cost[p] + d, p
        cost = new
        came.append(via)
    sizes, q = [], n
    for via in reversed(came):
        sizes.append(q - via[q])
        q = via[q]
    return sizes[::-1]


class Page:
    """The state of matching one page: words(line, pos, text, label) in order, boxes(text, x, y, h) in the order they are listed."""

    def __init__(self, words: list[tuple], boxes: list[tuple]):
        self.words, self.boxes = words, boxes
        self.at = np.array([b[1:3] for b in boxes], float).reshape(len(boxes), 2)
        self.height = float(np.median([b[3] for b in boxes])) if boxes else 0.0
        self.alike = scores([w[2] for w in words], [b[0] for b in boxes])
        self.free = np.ones(len(boxes), bool)
        self.got: dict[int, tuple[int, ...]] = {}
        self.how: dict[int, str] = {}
        self.lines: dict = defaultdict(list)
        for k, w in enumerate(words):
            self.lines[w[0]].append(k)
        self.order = {line: k for k, line in enumerate(self.lines)}
        self.names = list(self.lines)

    def centre(self, k: int) -> np.ndarray:
        return self.at[list(self.got[k])].mean(axis=0)

    def take(self, word: int, boxes: tuple[int, ...], how: str) -> None:
        self.got[word], self.how[word] = boxes, how
        self.free[list(boxes)] = False

    def expected(self, word: int, own: bool = False):
        """Where a word should be and how far off it may be, from its line's placed words or, unless own, the lines around; else None."""
        line = self.lines[self.words[word][0]]
        placed = [k for k in line if k in self.got]
        cut = bisect_left(placed, word)
        if 0 < cut < len(placed):
            a, b = self.centre(placed[cut - 1]), self.centre(placed[cut])
            return (a + b) / 2, float(np.linalg.norm(b - a)) / 2 + REACH
        if placed:
            return self.centre(placed[cut - 1] if cut else placed[0]), 2 * REACH
        if not own:
            n = self.order[self.words[word][0]]
            for d in range(1, AROUND + 1):
                near = [self.centre(k) for m in (n - d, n + d) if 0 <= m < len(self.names) for k in self.lines[self.names[m]] if k in self.got]
                if near:
                    return np.mean(near, axis=0), FAR_AWAY
        return None

    def run(self, group: list[int]) -> tuple[float, list[tuple[int, int]]]:
        """The best run of a group's words not yet placed among the boxes not yet taken: score and pairs (word, box), none if it doesn't convince."""
        left = [k for k in group if k not in self.got]
        rank = np.cumsum(self.free) - 1
        points = [(n, int(rank[x]), s, x) for n, k in enumerate(left) for x, s in self.alike[k] if self.free[x]]
        if not points:
            return 0.0, []
        box = {p[1]: p[3] for p in points}
        chain = best_chain([p[:3] for p in points])
        # cut where next-door words are far apart, and keep the longest part
        parts = [[chain[0]]]
        for p, q in zip(chain, chain[1:], strict=False):
            if np.linalg.norm(self.at[box[q[1]]] - self.at[box[p[1]]]) > JUMP * self.height * (q[0] - p[0]):
                parts.append([])
            parts[-1].append(q)
        part = max(parts, key=len)
        score = sum(p[2] for p in part) - GAP * max(0, part[-1][1] - part[0][1] - (len(part) - 1))
        if len(part) == 1:
            n, j, s = part[0]
            same = sum(1 for p in points if p[0] == n and p[2] == EXACT)
            here = self.expected(left[n], own=True)
            if s < EXACT or same > 1 or (here and np.linalg.norm(self.at[box[j]] - here[0]) > here[1]):
                return 0.0, []
        return score, [(left[n], box[j]) for n, j, _ in part]

    def runs(self) -> None:
        """Runs along lines, and along lists of labels of a word each, the best one first."""
        groups = list(self.lines.values())
        row: list[int] = []
        for ks in [*self.lines.values(), []]:
            if len(ks) == 1 and self.words[ks[0]][3]:
                row.append(ks[0])
            else:
                if len(row) >= 3:
                    groups.append(row)
                row = []
        told: dict[int, tuple] = {}
        could = [[x for w in group for x, _ in self.alike[w]] for group in groups]
        reach = [(min(c), max(c)) if c else None for c in could]
        on = [{self.words[w][0] for w in group} for group in groups]
        while True:
            for g, group in enumerate(groups):
                if g not in told:
                    told[g] = self.run(group)
            g = max(told, key=lambda k: (told[k][0], -k), default=None)
            if g is None or told[g][0] < EXACT:
                return
            taken = told[g][1]
            for word, x in taken:
                self.take(word, (x,), "run")
            # a group's run may change if its words were placed, or boxes between those it could take
            words, boxes = {w for w, _ in taken}, [x for _, x in taken]
            lines = {self.words[w][0] for w in words}
            for k, r in enumerate(reach):
                if r and (on[k] & lines or any(r[0] <= x <= r[1] for x in boxes)):
                    told.pop(k, None)

    def between(self) -> None:
        """Words between two placed ones of their line take the free boxes listed between those two, if these lie where the line runs."""
        for line in self.lines.values():
            placed = [k for k in line if k in self.got]
            for a, b in zip(placed, placed[1:], strict=False):
                words = [k for k in line if a < k < b]
                listed = list(range(self.got[a][-1] + 1, self.got[b][0]))
                if not words or not listed or not len(words) <= len(listed) <= len(words) + SPARE or not self.free[listed].all():
                    continue
                p, q = self.centre(a), self.centre(b)
                if (np.linalg.norm(self.at[listed] - (p + q) / 2, axis=1) > np.linalg.norm(q - p) / 2 + REACH).any():
                    continue
                sizes = shared_out([self.boxes[x][0] for x in listed], [self.words[k][2] for k in words])
                for k, e, n in zip(words, np.cumsum(sizes).tolist(), sizes, strict=True):
                    self.take(k, tuple(listed[e - n : e]), "between")

    def offer(self, word: int):
        """The best free box for a word on its own: (less its score, distance, word, box), or None."""
        near = [(x, s) for x, s in self.alike[word] if self.free[x]]
        if not near:
            return None
        top = max(s for _, s in near)
        able = [x for x, s in near if s == top]
        here = self.expected(word)
        if here is None:
            return -top, 1e6, word, able[0]
        far = np.linalg.norm(self.at[able] - here[0], axis=1)
        k = int(far.argmin())
        return (-top, float(far[k]), word, able[k]) if far[k] <= here[1] else None

    def leftovers(self) -> None:
        """What is left, one by one: the best reading, then the nearest, where its line or the lines around it run."""
        told = {k: self.offer(k) for k in range(len(self.words)) if k not in self.got}
        while offers := [o for o in told.values() if o]:
            _, _, word, x = min(offers)
            self.take(word, (x,), "one")
            del told[word]
            n = self.order[self.words[word][0]]
            for k in told:
                if abs(self.order[self.words[k][0]] - n) <= AROUND or any(y == x for y, _ in self.alike[k]):
                    told[k] = self.offer(k)

    def matched(self) -> list[tuple[int, tuple[int, ...], str]]:
        self.runs()
        self.between()
        self.leftovers()
        return [(k, self.got[k], self.how[k]) for k in sorted(self.got)]


def boxes_shared_out(rows: DataFrame) -> DataFrame:
    """rows(words, boxes, ...) and sizes: how many of the boxes' texts, in order, each word's text gets; null where there are fewer boxes than words, or no words."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<int>")
    def sizes(words, boxes):
        import pandas as pd

        return pd.Series([shared_out(list(b), list(w)) if w is not None and b is not None and 0 < len(w) <= len(b) else None for w, b in zip(words, boxes, strict=True)])

    return spread(rows).withColumn("sizes", sizes("words", "boxes"))


def match_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, line, pos, boxes, how: the boxes of each word that has some.

    words(page, line, pos, text, label) in order of (line, pos); boxes(page, box, text, x, y, h) in order of box, with
    their centres. how is run, between or one. A page is a group: what one reader sees. Null texts read as empty and
    match nothing but empty ones; pages without boxes or words give no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}

    def one(left, right):
        rows = sorted(zip(*(left[n] for n in ("line", "pos", "text", "label")), strict=True), key=lambda r: [(v is None, v if v is not None else 0) for v in r[:2]])
        listed = sorted(zip(*(right[n] for n in ("box", "text", "x", "y", "h")), strict=True), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
        told = Page([(line, pos, text or "", label) for line, pos, text, label in rows], [(t or "", x, y, h) for _, t, x, y, h in listed]).matched()
        return [(*rows[k][:2], [listed[x][0] for x in xs], how) for k, xs, how in told]

    out = f"line {kinds['line']}, pos {kinds['pos']}, boxes array<{boxes.schema['box'].dataType.simpleString()}>, how string"
    return each_group(words.select("page", "line", "pos", "text", "label"), boxes.select("page", "box", "text", "x", "y", "h"), "page", one, out)


def _ranks(*arrays):
    """Equal values of arrays of one type as equal numbers, which are in the values' order; -1 is null. And the values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = pc.unique(pa.concat_arrays([a.drop_null() for a in arrays]))
    values = values.take(pc.array_sort_indices(values))
    return *(pc.fill_null(pc.index_in(a, values), -1).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays), values


def _of_lists(lists):
    """The list and the place in it of each element of lists."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - starts[of], starts


def _firsts(*keys):
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _repeated(n):
    """0 to n[0] - 1, 0 to n[1] - 1, ..., and which of n each belongs to."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n)[of], of


def _transferred(batch, bin_size: int):
    """line, word, panel, x0, y0, x1, y1, est of many lines; glyphs are aligned line by line, spans and boxes by sorting.

    Spans meet by bins of their line, a pair in the bin where its overlap begins.
    """
    import pyarrow as pa

    own, own_word, shown, shown_word, boxes = (batch.column(c) for c in ("own", "own_word", "shown", "shown_word", "boxes"))
    bx = boxes.flatten()
    a, b, _ = _ranks(own.flatten(), shown.flatten())
    a, b, i, j = a.tolist(), b.tolist(), _of_lists(own)[2].tolist(), _of_lists(shown)[2].tolist()
    at = np.array([x for k in range(batch.num_rows) for x in glyph_map(b[j[k] : j[k + 1]], a[i[k] : i[k + 1]])], float)
    # the span of each word of either reading
    sw, bw, _ = _ranks(shown_word.flatten(), bx.field("word"))
    line, k, _ = _of_lists(shown_word)
    by = np.lexsort((k, sw, line))
    line, sw, k = line[by], sw[by], k[by]
    first = _firsts(line, sw)
    wide = max(int(bw.max(initial=0)), int(sw.max(initial=0))) + 2
    has, low, high = line[first] * wide + sw[first] + 1, k[first], k[np.append(first[1:], len(k))[: len(first)] - 1] + 1
    ow, of_values = _ranks(own_word.flatten())
    line = _of_lists(own_word)[0]
    by = np.lexsort((at, ow, line))
    line, ow, at = line[by], ow[by], at[by]
    first = _firsts(line, ow)
    w_line, w_of, j0, j1 = line[first], ow[first], at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + 1
    # boxes of words that have a span, by bins
    b_line = _of_lists(boxes)[0]
    spot = np.searchsorted(has, b_line * wide + bw + 1)
    box = np.flatnonzero((bw >= 0) & (spot < len(has)) & (has[np.minimum(spot, len(has) - 1)] == b_line * wide + bw + 1)) if len(has) else np.array([], np.int64)
    lo, hi = np.zeros(len(bw), np.int64), np.zeros(len(bw), np.int64)
    lo[box], hi[box] = low[spot[box]], high[spot[box]]
    more, which = _repeated(hi[box] // bin_size - lo[box] // bin_size + 1)
    entry = box[which]
    bins = lo[entry] // bin_size + more
    many = int(max(bins.max(initial=0), j1.max(initial=0) // bin_size)) + 3
    key = b_line[entry] * many + bins + 1
    by = np.argsort(key, kind="stable")
    entry, key = entry[by], key[by]
    start = np.floor(j0 / bin_size).astype(np.int64)
    more, want = _repeated(np.floor(j1 / bin_size).astype(np.int64) - start + 1)
    bins = start[want] + more
    asked = w_line[want] * many + bins + 1
    from_ = np.searchsorted(key, asked)
    more, which = _repeated(np.searchsorted(key, asked, "right") - from_)
    want, bins, x = want[which], bins[which], entry[from_[which] + more]
    n = hi[x] - lo[x]
    f0, f1 = np.maximum(0.0, (j0[want] - lo[x]) / np.maximum(n, 1)), np.minimum(1.0, (j1[want] - lo[x]) / np.maximum(n, 1))
    fit = (hi[x] > j0[want]) & (lo[x] < j1[want]) & (np.floor(np.maximum(lo[x], j0[want]) / bin_size) == bins) & (f1 - f0 >= SLIVER)
    want, x, f0, f1 = want[fit], x[fit], f0[fit], f1[fit]
    # the panel that most of a word's parts are in; of equals the one with the first word
    panel, panels = _ranks(bx.field("panel"))
    by = np.lexsort((bw[x], panel[x], want))
    want, x, f0, f1 = want[by], x[by], f0[by], f1[by]
    first = _firsts(want, panel[x])
    count = np.diff(np.append(first, len(want)))
    best = np.lexsort((panel[x][first], bw[x][first], -count, want[first]))
    best = best[_firsts(want[first][best])]
    main, whole = np.full(len(w_of), -1), np.ones(len(w_of), bool)
    main[want[first][best]] = panel[x][first][best]
    np.logical_and.at(whole, want, (f0 <= START) & (f1 >= END))
    kept = (main[want] >= 0) & (panel[x] == main[want])
    want, x, f0, f1 = want[kept], x[kept], f0[kept], f1[kept]
    first = _firsts(want)
    told = want[first]
    left, top, w, h = (bx.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[x] for c in ("x", "y", "w", "h"))
    flat, tall = w >= h, w < h
    low_of = lambda v, size, along: np.fmin.reduceat(v + np.where(along, size * f0, 0.0), first) if len(first) else np.array([])
    high_of = lambda v, size, along: np.fmax.reduceat(v + np.where(along, size * f1, size), first) if len(first) else np.array([])
    sides = low_of(left, w, flat), low_of(top, h, tall), high_of(left, w, flat), high_of(top, h, tall)
    est = bx.field("est").cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)[x]
    est = np.maximum.reduceat(est, first) if len(first) else np.array([])
    sure = (est == 1) | ~whole[told]
    take = lambda values, at: values.take(pa.array(at.astype(np.int64)))
    return [take(batch.column("line"), w_line[told]), pa.array(w_of[told], pa.int64(), mask=w_of[told] < 0), take(panels, main[told]), *(pa.array(v, pa.float64(), from_pandas=True) for v in sides), pa.array(sure, pa.bool_(), mask=(est == -1) & ~sure)], of_values


def transfer_by_glyphs(lines: DataFrame, boxes: DataFrame, bin_size: int = 8) -> DataFrame:
    """line, word, panel, x0, y0, x1, y1, est: boxes for the words of another reading of each line, from the words' boxes of the first.

    lines(line, own, own_word, shown, shown_word): the glyphs of both readings in order and the word each belongs to;
    own is the other one. boxes(line, word, panel, x, y, w, h, est) are those of shown's words. A glyph of own stands
    where the alignment sets it in shown, so a word of own covers a span of shown's glyphs; it takes the covered part of
    every box that has enough of it, along the longer side, in the panel that most of these are in. est: a part was cut,
    or a box is itself estimated.
    """
    ship(lines.sparkSession)
    kind = {f.name: f.dataType for f in lines.schema.fields}
    told = boxes.select("line", F.struct(F.col("word").cast(kind["shown_word"].elementType).alias("word"), "panel", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), "est").alias("box"))
    held = lines.select("line", "own", "own_word", "shown", "shown_word").join(told.groupBy("line").agg(F.collect_list("box").alias("boxes")), "line")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            (line, word, *rest), words = _transferred(batch, bin_size)
            yield pa.RecordBatch.from_arrays([line, words.take(word), *rest], ["line", "word", "panel", "x0", "y0", "x1", "y1", "est"])

    word, panel = kind["own_word"].elementType.simpleString(), boxes.schema["panel"].dataType.simpleString()
    return held.mapInArrow(scan, f"line {kind['line'].simpleString()}, word {word}, panel {panel}, x0 double, y0 double, x1 double, y1 double, est boolean")
