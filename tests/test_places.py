"""Folds, box matching, shapes, costs and bounded search against brute force on small cases."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.distances import likeness
from glyphmill.functions.glyphs import glyph_map
from glyphmill.operators import comparison as M
from glyphmill.operators import boxes as B
from glyphmill.operators import consensus as V
from glyphmill.operators import folds as L
from glyphmill.operators import search as S
from glyphmill.operators import shapes as H
from glyphmill.operators import sheets as T
from glyphmill.plans.language import LONGEST, QueryError, parse


def stack_by_insertion(ways):
    """The stack as a list that each piece is put into."""
    stack = [0]
    for j in range(1, len(ways)):
        i = stack.index(j - 1)
        up = 1 if (j - 1) % 2 == 0 else -1
        stack = [*stack[: i + 1], j, *stack[i + 1 :]] if up * ways[j] > 0 else [*stack[:i], j, *stack[i:]]
    return stack


def test_stacks_of_all_folds(spark):
    ways = [[1, *w] for n in range(6) for w in itertools.product((1, -1), repeat=n)]
    rows = spark.createDataFrame([(w,) for w in ways], "ways array<int>").select("ways", L.stack_order(F.col("ways")).alias("stack")).collect()
    assert all(r.stack == stack_by_insertion(r.ways) for r in rows)


LEAF = "sheet string, leaf int, pieces array<struct<width:int,way:int,low:int,high:int,front:string,back:string,front_page:string,back_page:string>>"


def leaf(sheet, *pieces):
    return (sheet, 0, [(w, way, 0, 10, f"{sheet}{k}r", f"{sheet}{k}v", f"{sheet}r", f"{sheet}v") for k, (w, way) in enumerate(pieces)])


def test_contacts_confirmed_inferred_and_new(spark):
    leaves = spark.createDataFrame([leaf("x", (10, 1), (8, 1), (6, 1)), leaf("y", (10, 1)), leaf("z", (10, 1), (5, -1)), leaf("w", (10, 1), (10, 1))], LEAF)
    stacks = L.stacked(leaves)
    found = {(r.sheet, r.a_name, r.b_name) for r in L.fold_contacts(stacks).collect()}
    # piece 1 lies face down on 0; piece 2 hangs from 1, which looks down, so a fold that goes in tucks it between
    assert found == {("x", "x0r", "x2v"), ("x", "x2r", "x1r"), ("z", "z1v", "z0v"), ("w", "w0r", "w1r")}
    records = spark.createDataFrame([("x", False, [("x1r", "x0r"), ("nothing", "x0r")]), ("w", True, None)], "sheet string, every boolean, touch array<struct<a:string,b:string>>")
    told = {(r.sheet, r.a_name, r.b_name): r.fold for r in L.sheet_contacts(stacks, records).collect()}
    assert told == {("x", "x1r", "x0r"): "confirmed", ("x", "x0r", "x2v"): "inferred", ("x", "x2r", "x1r"): "inferred", ("z", "z1v", "z0v"): "inferred", ("w", "w0r", "w1r"): "confirmed"}
    base = spark.createDataFrame([("x", "x2v", "x0r")], "sheet string, a_name string, b_name string")
    new = {(r.a_name, r.b_name): r.is_new for r in L.marked_new(L.fold_contacts(stacks), base, ("sheet",)).collect()}
    assert new == {("x0r", "x2v"): False, ("x2r", "x1r"): True, ("z1v", "z0v"): True, ("w0r", "w1r"): True}
    assert L.sheet_contacts(stacks.limit(0), records).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_and_scores():
    rng = random.Random(3)
    a, b = (["".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(30)] for _ in range(2))
    d = B.edits(a, b)
    assert all(d[i, j] == plain_edits(x, y) for i, x in enumerate(a) for j, y in enumerate(b))
    assert B.scores(["abcde", "q"], ["abcde", "abcdx", "abxyz", "abcde"]) == {0: [(0, 3.0), (1, 2.0), (3, 3.0)], 1: []}


def test_chain_has_the_score_of_a_full_local_alignment():
    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randint(1, 6), rng.randint(1, 7)
        s = [[rng.choice((3.0, 2.0, 1.0, -2.0, -2.0, -2.0)) for _ in range(m)] for _ in range(n)]
        h = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                h[i + 1][j + 1] = max(0, h[i][j] + s[i][j], h[i][j + 1] - 1, h[i + 1][j] - 1)
        best = max(map(max, h))
        points = [(i, j, s[i][j]) for i in range(n) for j in range(m) if s[i][j] > 0]
        if not points:
            continue
        chain = B.best_chain(points)
        cost = sum((q[0] - p[0] - 1) + (q[1] - p[1] - 1) for p, q in itertools.pairwise(chain))
        assert sum(p[2] for p in chain) - cost == best


def test_boxes_are_shared_out_at_the_least_cost(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        boxes = ["".join(rng.choices("ab", k=rng.randint(0, 3))) for _ in range(rng.randint(1, 6))]
        rows.append((["".join(rng.choices("ab", k=3)) for _ in range(rng.randint(1, 4))], boxes))
    rows += [([], ["a"]), (None, ["a"]), (["a"], None)]
    for r in B.boxes_shared_out(spark.createDataFrame(rows, "words array<string>, boxes array<string>")).collect():
        if not r.words or r.boxes is None or len(r.words) > len(r.boxes):
            assert r.sizes is None
            continue
        cost = lambda cuts, r=r: sum(plain_edits(w, "".join(r.boxes[i:j])) for w, (i, j) in zip(r.words, itertools.pairwise(cuts), strict=True))
        ways = [(0, *c, len(r.boxes)) for c in itertools.combinations(range(1, len(r.boxes)), len(r.words) - 1)]
        assert sum(r.sizes) == len(r.boxes) and cost([0, *itertools.accumulate(r.sizes)]) == min(map(cost, ways))


def test_matching_keeps_to_where_lines_run(spark):
    words = [("p", 1, 0, "daiin", False), ("p", 1, 1, "qokedyx", False), ("p", 1, 2, "shol", False), ("p", 2, 0, "cthy", False), ("p", 2, 1, "chedar", False), ("p", 3, 0, None, False), ("q", 1, 0, "daiin", False)]
    boxes = [("p", 0, "chedar", 60, 100, 20), ("p", 1, "daiin", 0, 0, 20), ("p", 2, "qoke", 50, 0, 20), ("p", 3, "dyx", 70, 0, 20), ("p", 4, "shol", 120, 0, 20), ("p", 5, "cthy", 0, 100, 20), ("p", 6, "zzzzz", 900, 900, 20), ("r", 0, "daiin", 0, 0, 20)]
    w = spark.createDataFrame(words, "page string, line int, pos int, text string, label boolean")
    b = spark.createDataFrame([(*x[:3], *map(float, x[3:])) for x in boxes], "page string, box int, text string, x double, y double, h double")
    told = {(r.page, r.line, r.pos): (r.boxes, r.how) for r in B.match_boxes(w, b).collect()}
    assert told == {("p", 1, 0): ([1], "run"), ("p", 1, 1): ([2, 3], "between"), ("p", 1, 2): ([4], "run"), ("p", 2, 0): ([5], "run"), ("p", 2, 1): ([0], "run")}
    assert B.match_boxes(w.limit(0), b).count() == 0 and B.match_boxes(w, b.limit(0)).count() == 0


def test_boxes_by_glyphs_of_one_line(spark):
    shown, words = ["a", "b", "c", "d", "e", "f"], [0, 0, 0, 1, 1, 1]
    own, own_words = ["a", "b", "c", "d", "x", "e", "f"], [0, 0, 1, 1, 1, 1, 2]
    assert glyph_map(shown, own) == [0, 1, 2, 3, 3.5, 4, 5]
    lines = spark.createDataFrame([("l", own, own_words, shown, words), ("n", None, None, None, None)], "line string, own array<string>, own_word array<int>, shown array<string>, shown_word array<int>")
    boxes = spark.createDataFrame([("l", 0, "left", 0.0, 0.0, 30.0, 10.0, False), ("l", 1, "left", 40.0, 0.0, 10.0, 30.0, True)], "line string, word int, panel string, x double, y double, w double, h double, est boolean")
    told = {r.word: (r.panel, r.x0, r.y0, r.x1, r.y1, r.est) for r in B.transfer_by_glyphs(lines, boxes).collect()}
    assert told[0] == ("left", 0.0, 0.0, 20.0, 10.0, True)
    assert told[1] == ("left", 20.0, 0.0, 50.0, 20.0, True)  # the end of the first box, the upper part of the tall second one
    assert told[2] == ("left", 40.0, 20.0, 50.0, 30.0, True)


def test_costs_are_fitted_to_a_fixed_point(spark):
    alphabet = V.Alphabet({c.upper() + "1": c for c in "abxn"}, strokes={"A1": "q1", "B1": "s1", "X1": "s2", "N1": "t1"})
    coded = lambda t: "".join(c.upper() + "1" for c in t)
    rows = [(f"{k}", w, coded("nnxann" if w != "LU" else "nnbnn" if k % 3 == 0 else "nnxbnn")) for k in range(60) for w in ("ZL", "GC", "LU")]
    told = V.fit_costs(spark.createDataFrame(rows, "locus string, witness string, text string"), alphabet).collect()
    # at first b stands for x in 20 lines; once a against b is cheap, there too
    assert [(r.a, r.b, r.n, r.cost) for r in told] == [("a", "b", 60.0, 0.15)] and told[0]["round"] > 1


def test_slanted_and_level_lines(spark):
    rows = [(1, 0, "P", k, 4, 100.0 + 50 * k, 100.0 + 20 * k, 140.0 + 50 * k, 114.0 + 20 * k, False) for k in range(4)]
    rows += [(1, 1, "P", k, 4, 100.0 + 50 * k, 300.0, 140.0 + 50 * k, 314.0, False) for k in range(4)] + [(1, 1, "P", 4, 6, 300.0, 300.0, 303.0, 303.0, False), (1, 2, "C", 0, 3, None, None, None, None, None)]
    told = {(r.line, r.word): r for r in H.shapes(spark.createDataFrame(rows, "page int, line int, kind string, word int, glyphs int, x0 double, y0 double, x1 double, y1 double, est boolean")).collect()}
    assert all(told[0, k].shape == "o" and abs(told[0, k].angle - 21.8) < 0.1 for k in range(4))
    assert all(told[1, k].shape == "r" and told[1, k].angle == 0 for k in range(5)) and (2, 0) not in told
    assert told[1, 4].est and told[1, 4].p[3] == 14.0  # a sliver gets a line's height


def test_a_search_that_runs_away_ends(spark):
    lines = spark.createDataFrame([(1, 0, "a" * 40 + "b", "P", True), (2, 0, "the.an", "P", True)], "page long, num int, line string, kind string, ps boolean")
    began = time.time()
    with pytest.raises(Exception, match="more than 1 seconds on one line"):
        S.search(lines, "/(a|a)+[cd]/", seconds=1).collect()
    assert time.time() - began < 60
    hits = S.search(lines, "/(?<x>[aeh])/", seconds=1).select("page", "start", "match").collect()
    assert [(r.page, r.start, r.match) for r in hits if r.page == 2] == [(r.page, r.start, r.match) for r in S.search(lines, "/(?<x>[aeh])/").select("page", "start", "match").collect() if r.page == 2]
    with pytest.raises(QueryError, match=str(LONGEST)):
        parse("a" * (LONGEST + 1))


def test_likes_and_alignment_of_sheets():
    rng = random.Random(8)
    a, b = (["".join(rng.choices("ab?*", (6, 6, 1, 1), k=rng.randint(0, 5))) for _ in range(25)] for _ in range(2))
    d = T.likes(a, b)
    assert all(abs(d[i, j] - likeness(x, y)) < 1e-9 for i, x in enumerate(a) for j, y in enumerate(b))
    import numpy as np

    for _ in range(100):
        t = np.array([[rng.choice((1.0, 0.8, 0.6, 0.1)) for _ in range(rng.randint(1, 1) + 4)] for _ in range(4)])
        h = np.zeros((5, 6))
        for i in range(4):
            for j in range(5):
                w = 2.0 if t[i, j] == 1 else 1.2 if t[i, j] >= 0.75 else 0.5 if t[i, j] >= 0.6 else -1.0
                h[i + 1, j + 1] = max(0, h[i, j] + w, h[i, j + 1] - 0.8, h[i + 1, j] - 0.8)
        score, pairs = T.aligned(t)
        assert abs(score - h.max()) < 1e-9 and all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))


def test_sheet_words_joined_split_and_far_away(spark):
    words = [("s", 1, 0, "abcdefgh", 0.0, 0.0), ("s", 1, 1, "ijklmnop", 0.0, 0.0), ("s", 1, 2, "qrstuvwx", 0.0, 0.0), ("s", 1, 3, "yzabxcdu", 0.0, 0.0), ("s", 2, 0, "mmmmoooo", 0.0, 100.0), ("s", 3, 0, None, None, None)]
    read = [("s", "p", 0, 10, "abcdefgh", 0.0, 0.0), ("s", "p", 1, 11, "ijklmnopqrstuvwx", 10.0, 0.0), ("s", "p", 2, 12, "yzab", 20.0, 0.0), ("s", "p", 3, 13, "xcdu", 30.0, 0.0), ("s", "q", 0, 14, "mmmmoooo", 5000.0, 0.0), ("s", "r", 0, 15, "mmmmooox", 10.0, 90.0)]
    w = spark.createDataFrame([(*x, None, None) for x in words], "page string, line int, pos int, text string, x double, y double, sure double, region string")
    r = spark.createDataFrame([(*x, None) for x in read], "page string, run string, at int, id int, text string, x double, y double, region string")
    told = {(t.line, t.pos): (t.readings, t.kind, t.first, t.last) for t in T.match_sheet(w, r).collect()}
    assert told == {(1, 0): ([10], "whole", 0.0, 1.0), (1, 1): ([11], "join", 0.0, 0.5), (1, 2): ([11], "join", 0.5, 1.0), (1, 3): ([12, 13], "split", 0.0, 1.0), (2, 0): ([15], "whole", 0.0, 1.0)}


def test_comparison_of_lines(spark):
    rows = [("VT", "f1", "Herbal", "a", "qo.ke,dy.chol", "qo.kedy.chor"), ("VT", "f1", "Herbal", "b", "daiin", None), ("VT", "f2", "Stars", "c", "a.b", "a.b"), ("VT", "f2", "Stars", "d", "sho", "sh@221;")]
    facts = M.compared(spark.createDataFrame(rows, "name string, page string, section string, locus string, c string, o string"))
    by = {r.locus: r for r in facts.collect()}
    assert (by["a"].words, by["a"].differ, by["a"].joined_words, by["a"].joined_differ, by["a"].match, by["a"].glyphs) == (4, 3, 3, 1, 9, 10) and by["b"].missing and by["c"].same
    assert {r.kind: r.n for r in M.kinds(facts).collect()} == {"glyphs": 3, "inbetween": 1}
    lines = [r.value for r in M.comparison_report(facts, ["VT"], "T").orderBy("row").collect()]
    assert lines[0] == "# T" and "| loci it lacks | 1 |" in lines and "| words that differ | 4 (" not in lines and "| Herbal | 4 | 3 | 75.0% |" in lines
