"""Work that must not grow with the square of a page or sheet, held against the plain way on small input."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions.grouped import each_group
from glyphmill.operators import boxes as B
from glyphmill.operators import orders as O
from glyphmill.operators import sheets as T
from glyphmill.operators import spatial as G


def test_close_pairs_are_all_pairs_within_the_share(monkeypatch):
    rng = random.Random(4)
    texts = lambda letters, n, m: ["".join(rng.choices(letters, k=rng.randint(0, m))) for _ in range(n)]
    for letters, m in (("ab", 8), ("abcdé😀", 12), ("abcdefgh", 20)):
        a, b = texts(letters, 70, m), texts(letters, 50, m)
        b += [t[1:] + "a" for t in a[:20]] + a[:5]
        d = B.edits(a, b)
        for share in (0.34, 0.4, 1.0):
            want = {(i, j, d[i, j]) for i, x in enumerate(a) for j, y in enumerate(b) if d[i, j] <= np.floor(share * max(len(x), len(y)) + 1e-9)}
            assert set(zip(*(c.tolist() for c in B.close_pairs(a, b, share)), strict=True)) == want
    # unlike texts aren't set against each other letter by letter
    n, plain = [], B._edits_of
    monkeypatch.setattr(B, "_edits_of", lambda x, *rest: n.append(len(x)) or plain(x, *rest))
    words = ["".join(rng.choices("abcdefghijklmnop", k=20)) for _ in range(300)]
    assert B.scores(words, words) == {k: [(k, B.EXACT)] for k in range(300)} and sum(n) < 300 * 300 / 20


def test_few_points_chain_as_many_do(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        points = [(rng.randint(0, 8), rng.randint(0, 8), rng.choice((1.0, 2.0, 3.0))) for _ in range(rng.randint(1, 12))]
        few = B.best_chain(points)
        with monkeypatch.context() as m:
            m.setattr(B, "FEW", 0)
            assert few == B.best_chain(points)


def test_likes_of_sheets_above_a_bound():
    rng = random.Random(2)
    a, b = (["".join(rng.choices("abc?", (6, 6, 6, 1), k=rng.randint(0, 9))) for _ in range(40)] for _ in range(2))
    whole, cut = T.likes(a, b), T.likes(a, b, 0.6)
    sure = whole >= 0.6
    assert (cut[sure] == whole[sure]).all() and (cut[~sure] < 0.6).all()


def test_groups_of_two_frames_with_a_null_key(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 8)], "k long, v int")
    right = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, w string")
    told = each_group(left, right, "k", lambda x, y: [(sum(x["v"]), y["w"])], "n int, w array<string>")
    assert {(r.k, r.n, tuple(r.w)) for r in told.collect()} == {(1, 11, ("a",)), (None, 7, ("b",))}


def test_contacts_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(O, "STRETCH", 2)
    rows = [(s, p, x, x + rng.choice((0, 1, 3, 8, -1)), rng.randint(0, 60)) for s in range(4) for p in range(40) for x in [rng.randint(0, 30)]]
    rows += [(None, 1, 0, 9, 1), (None, 2, 0, 9, 2), (9, 1, None, 5, 1), (9, 2, 0, 5, None)]
    told = O.contacts(spark.createDataFrame(rows, "sheet int, panel int, x0 int, x1 int, z int")).collect()
    z = {(s, p): k for s, p, _, _, k in rows}
    want = {}
    for s, p, a, b, k in rows:
        if s is not None and None not in (a, b, k):
            over = [y[4] for y in rows if y[0] == s and None not in y and y[4] > k and y[2] < b and a < y[3]]
            want |= {(s, p): min(over)} if over else {}
    assert {(r.sheet, r.a): z[r.sheet, r.b] for r in told} == want


def test_contacts_of_a_large_sheet(spark):
    n = 20_000  # 2e8 pairs
    p = spark.range(n).select(F.lit(1).alias("sheet"), F.col("id").alias("panel"), (F.col("id") * 7919 % 1000).alias("x0"), (F.col("id") * 7919 % 1000 + 900).alias("x1"), F.col("id").alias("z"))
    told = O.contacts(p)
    assert told.count() == n - 1 and "CartesianProduct" not in told._jdf.queryExecution().toString()


def test_nearest_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(G, "POINTS", 20)
    points = [(p, i, float(rng.randint(0, 9)), float(rng.randint(-20, 20))) for p in range(3) for i in range(70)] + [(0, 99, None, 1.0), (5, 1, 0.0, 0.0)]
    centres = [(p, c, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for p in range(3) for c in range(30)] + [(1, 40, None, 2.0)]
    told = G.nearest(spark.createDataFrame(points, "page int, id int, x double, y double"), spark.createDataFrame(centres, "page int, c int, cx double, cy double"))
    want = {}
    for p, i, x, y in points:
        far = [((x - cx) ** 2 + (y - cy) ** 2, c) for q, c, cx, cy in centres if q == p and None not in (x, cx)]
        if p < 3:
            want[p, i] = (min(far)[1], min(far)[0] ** 0.5) if far else (0, None)
    assert {(r.page, r.id): (r.c, r.d) for r in told.collect()} == want


def test_overlaps_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(G, "OWN", 7)
    rows = [(p, i, a, a + rng.randint(1, 90)) for p in range(2) for i in range(60) for a in [rng.randint(0, 300)]]
    left, right = (spark.createDataFrame([r for r in rows if r[1] % 2 == k], "page int, id int, a int, b int") for k in (0, 1))
    share = lambda l, r: (min(l[3], r[3]) - max(l[2], r[2])) / (l[3] - l[2])
    want = sorted((l[0], l[1], r[1]) for l in rows for r in rows if l[0] == r[0] and l[1] % 2 == 0 and r[1] % 2 and share(l, r) > 0 and share(l, r) >= 0.15)
    assert sorted((r.page, r.left_id, r.right_id) for r in G.overlaps(left, right).collect()) == want
