"""What used to be windows and arrays over words, worked out on slices of lines: against the plain way, line by line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import grouped
from glyphmill.operators import search as S
from glyphmill.operators import spatial as G
from glyphmill.operators import tokens as T
from glyphmill.sources import corpus as C

LINE = "page long, num int, line string, kind string, ps boolean"


def text(rng, n):
    return "".join(w + rng.choice(".,") for w in rng.choices(["a", "b", "ab", "ж", "größe", "xw"], k=n))[:-1]


@pytest.fixture
def lines(spark):
    rng = random.Random(8)
    rows = [(p, k, text(rng, 900 if (p, k) == (3, 1) else rng.randint(0, 12)), "P", True) for p in range(12) for k in range(5)]
    return rows, spark.createDataFrame([*rows, (99, 0, None, "P", True)], LINE).coalesce(1)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_slices_hold_all_rows_within_their_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"line": ["ab", None, "x" * 50, "", "cd", "ж", "e"]})
    parts = [s.column("line").to_pylist() for s in grouped.slices(batch, "line", 5)]
    assert sum(parts, []) == batch.column("line").to_pylist() and parts == [["ab", None], ["x" * 50], ["", "cd", "ж", "e"]]


def test_joined_words_without_a_shuffle_or_the_line_beside_each_word(lines):
    rows, frame = lines
    want = set()
    for p, k, line, *_ in rows:
        parts = re.split("([.,])", line)
        want |= {(p, k, i // 2, parts[i] + parts[i + 2]) for i in range(0, len(parts) - 2, 2) if parts[i + 1] == ","}
    told = T.joined_words(frame)
    assert shuffles(told) == 0 and told.count() == len(want) and {tuple(r) for r in told.collect()} == want


def test_repeats_without_a_shuffle(lines):
    rows, frame = lines
    want = set()
    for p, k, line, *_ in rows:
        words = re.split("[.,]", line) if line else []
        arcs = {(i, next((j - i for j in range(i + 1, len(words)) if words[j] == w), None)) for i, w in enumerate(words)}
        for i, d in arcs:
            if d and (i - 1, d) not in arcs:
                n = next(n for n in range(1, len(words) + 1) if (i + n, d) not in arcs)
                want.add((p, k, i, i + d, n))
    told = T.repeats(frame)
    assert shuffles(told) == 0 and told.count() == len(want) and {tuple(r) for r in told.collect()} == want


def plain_boxes(words):
    out, at = [], [sum(g for g, *_ in words[:i]) for i in range(len(words))]
    for i, (g, x, w) in enumerate(words):
        k = next((j for j in range(i - 1, -1, -1) if words[j][1] is not None), None)
        m = next((j for j in range(i + 1, len(words)) if words[j][1] is not None), None)
        room = None
        if k is not None and m is not None and at[m] != at[k] + words[k][0] and words[k][2] is not None:
            room = (words[m][1] - words[k][1] - words[k][2]) / (at[m] - at[k] - words[k][0])
        fill = lambda v, y: v if v is not None else None if room is None else y()  # noqa: B023, E731
        out.append((fill(x, lambda: words[k][1] + words[k][2] + (at[i] - at[k] - words[k][0]) * room), fill(w, lambda: g * room), x is None and room is not None))
    return out


def test_boxes_filled_in_any_order_and_over_batches(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for page in range(5):
        for li in [*range(8), None]:
            words = [(rng.randint(0, 4), float(x) if rng.random() < 0.3 else None, None) for x in range(0, 20 * rng.choice((1, 2, 40 if page == 2 else 3)), 20)]
            words = [(g, x, 5.0 if x is not None and rng.random() < 0.9 else None) for g, x, _ in words]
            rows += [(page, li, wi, *w) for wi, w in enumerate(words)]
            want |= {(page, li, wi): t for wi, t in enumerate(plain_boxes(words))}
    ddl = "page long, li int, wi int, glyphs int, x double, w double"
    near = lambda a, b: a is b or (a is not None and b is not None and abs(a - b) < 1e-5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for frame in (G.fill_boxes(spark.createDataFrame(rows, ddl).coalesce(1), in_order=True), G.fill_boxes(spark.createDataFrame(rows, ddl).orderBy(F.rand(1)))):
            got = {(r.page, r.li, r.wi): (r.x, r.w, r.est) for r in frame.collect()}
            assert got.keys() == want.keys()
            assert all(near(got[k][0], want[k][0]) and near(got[k][1], want[k][1]) and got[k][2] == want[k][2] for k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # the words of lines aren't shuffled
    assert shuffles(G.fill_boxes(spark.createDataFrame(rows, ddl), in_order=True)) == 0


def test_near_words_count_edits_for_few_spellings(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("xwhzabthoays", k=rng.randint(1, 7))) for _ in range(800)]
    frame = spark.createDataFrame([(".".join(words[i : i + 9]) + ",q",) for i in range(0, 800, 9)] + [(None,), ("",)], "line string")
    every = {w for i in range(0, 800, 9) for w in (".".join(words[i : i + 9]) + ",q").split(".")}
    for word in ("xwhz", "thar"):
        cost = S.near_cost(F.replace("w", F.lit(","), F.lit("")), word)
        want = {tuple(r) for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", cost.alias("cost")).filter("cost <= 2").collect()}
        told = S.near_words(frame, word, 2)
        assert {tuple(r) for r in told.collect()} == want
        # words leave the lines different and of a fitting length
        assert "Generate explode" not in told._jdf.queryExecution().executedPlan().toString()


def test_similar_pages_shuffle_only_words_of_the_page(spark, lines):
    _, frame = lines
    told = T.similar_pages(C.words(frame), 3)
    assert {r.page for r in told.collect()} <= set(range(12)) - {3}
    plan = T.similar_pages(C.words(frame), 3)._jdf.queryExecution().optimizedPlan().toString()
    # all joins by word send the page's words to the text
    by_word = [line for line in plan.splitlines() if "Join LeftSemi, (s#" in line or "Join Inner, (s#" in line]
    assert len(by_word) == 2 and all("broadcast" in line for line in by_word)


def test_equal_pairs_of_lines_are_compared_once(spark, monkeypatch):
    from glyphmill.operators import comparison as M

    plain = M._facts
    seen = []
    monkeypatch.setattr(M, "_kept_facts", M.lru_cache(M.KEPT)(lambda c, o: seen.append((c, o)) or plain(c, o)))
    pairs = [("ab.c,d", "ab.cd"), ("ab", None), (None, "x"), ("ab", ""), ("x" * 300, "x" * 299)] * 3
    assert [M.facts_of(*p) for p in pairs] == [plain(*p) for p in pairs] and len(seen) == 4
    frame = spark.createDataFrame([("VT", 1, "s", k, *p) for k, p in enumerate(pairs)], "name string, page int, section string, locus int, c string, o string")
    bare = M.compared(frame, edits=False)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted(map(tuple, M.compared(frame).drop("edits").collect()), key=str) and "edits" not in bare.columns
