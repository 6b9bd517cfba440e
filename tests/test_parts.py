"""Orders, places on pages, the store, and the entry module."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.operators import orders as O
from glyphmill.operators import spatial as G
from glyphmill.operators import store as U

BOOK = {"gatherings": [{"quire": "1", "type": "nested", "bifolia": ["a", "b", "c"]}, {"quire": "2", "type": "singulions", "bifolia": ["d"]}], "unplaced": ["u"]}


def names(book):
    return [g["bifolia"] for g in book["gatherings"]]


def test_nested_and_single_sheets(spark):
    rows = [("o", 1, "1", "nested", k, s) for k, s in enumerate(["S1", "S2", "S3"])] + [("o", 2, "2", "singulions", 0, "S4")]
    sides = O.linearise(spark.createDataFrame(rows, "order_id string, gi int, quire string, type string, pos int, sheet string"))
    got = [(r.sheet, r.face) for r in sides.orderBy("side").collect()]
    assert got == [(s, f) for s in ("S1", "S2", "S3") for f in (0, 1)] + [(s, f) for s in ("S3", "S2", "S1") for f in (2, 3)] + [("S4", f) for f in range(4)]
    first = O.openings(sides).orderBy("opening").first()
    assert (first.a, first.b) == (None, "S1:0")


def test_longest_rise():
    assert O.longest_rise([0, 1, 4, 2, 3]) == [0, 1, 3, 4] and O.longest_rise([]) == []


@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_rise_is_longest(v):
    from itertools import combinations

    got = O.longest_rise(v)
    assert all(v[a] < v[b] for a, b in zip(got, got[1:]))
    best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
    assert len(got) == best


def test_edits():
    assert names(O.move(BOOK, ["d", "a"], 0, 2)) == [["b", "a", "d", "c"]] and O.move(BOOK, ["a"], 0, 0) is None
    assert names(O.step(BOOK, "a", 1)) == [["b", "a", "c"], ["d"]] and O.step(BOOK, "c", 1) is None
    assert O.new_gathering(BOOK, ["b", "u"])["gatherings"][-1] == {"quire": "New 1", "type": "nested", "bifolia": ["b", "u"]}
    assert names(O.merge(BOOK, 0, 1)) == [["a", "b", "c", "d"]]
    cut = O.split(BOOK, 0, 1)
    assert names(cut) == [["a"], ["b", "c"], ["d"]] and [g["quire"] for g in cut["gatherings"]] == ["1a", "1b", "2"] and O.split(BOOK, 0, 0) is None
    aside = O.set_aside(BOOK, ["d"])
    assert aside["unplaced"] == ["u", "d"] and len(aside["gatherings"]) == 1
    assert names(O.put_back(aside, BOOK, ["d"])) == names(BOOK)
    assert O.rename(BOOK, 0, "2") is None and O.rename(BOOK, 0, "x")["gatherings"][0]["quire"] == "x"
    assert O.set_type(BOOK, 0, "nested") is None and names(O.reorder(BOOK, 0, 1)) == [["d"], ["a", "b", "c"]]
    assert O.changed_sheets(BOOK, O.step(BOOK, "a", 2)) == 1
    h = O.History(BOOK, 2)
    assert h.edit(O.step(BOOK, "a", 1)) and not h.edit(None) and h.undo() and h.book == BOOK and h.redo() and not h.redo()
    v = O.keep_version([], BOOK)
    assert O.keep_version(v, BOOK) == v and len(O.keep_version([{"n": i} for i in range(20)], BOOK)) == 20
    assert O.describe_gathering(["a", "b", "d"], {"a": "X", "b": "Y", "d": "Y"}, {"a": "1", "b": "1", "d": "2"}) == {"section": "Y", "quire": "1", "extras": ["d"]}


def test_turned_sheets(spark):
    d = spark.sql("select array(array(array(1, 2)), array(array(3, 4))) as faces, 1 as spine, 3 as n")
    turned = d.select(O.handled(F.col("faces"), F.col("spine"), F.col("n"), F.lit(True), F.lit(False)).alias("h"), O.handled(F.col("faces"), F.col("spine"), F.col("n"), F.lit(True), F.lit(True)).alias("k")).first()
    assert turned.h.faces == [[[3, 4]], [[1, 2]]] and turned.h.spine == 2 and turned.k.faces == [[[4, 3]], [[2, 1]]] and turned.k.spine == 1


def test_geometry(spark):
    one = spark.range(1)
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, "xywh")))
    r = one.select(box(0, 0, 2, 2).alias("a"), box(1, 1, 2, 2).alias("b")).select(G.iou("a", "b").alias("v")).first().v
    assert r == pytest.approx(1 / 7)
    w = one.select(*(G.wrapped(F.lit(float(a))) for a in (190, -190, 180, -180, 540))).first()
    assert list(w) == [-170, 170, 180, 180, 180]
    arc = one.select(G.arc_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(-10.0), F.lit(100.0)).alias("v")).first().v
    assert arc.x + arc.w == pytest.approx(2) and arc.y + arc.h == pytest.approx(2)
    assert one.select(G.lower_third(F.array(*map(F.lit, (5, 1, 4, 2, 3, 6))))).first()[0] == 3
    c = one.select(G.shape_centre(F.lit("r"), F.array(*(F.lit(float(x)) for x in (2, 4, 6, 8)))).alias("v")).first().v
    assert (c.x, c.y) == (5, 8)


def test_matching():
    words = "qokeedy dal chol daiin shedy okar".split()
    assert G.greedy_match(words, words) == [(i, i) for i in range(6)]
    boxes = ["qokeedy", "dal", "daiin", "shedy", "okar"]
    assert G.greedy_match(words, boxes) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    assert G.greedy_match([], boxes) == [] and G.local_alignment(["a"], ["zzz"])[0] == 0


def test_store(spark):
    sheets = spark.createDataFrame([("o", "a", "1", 1), ("o", "x", "1", 2), ("o", "a", "2", 3), ("o", "b", "2", 4)], "order_id string, sheet string, quire string, ord int")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "sheet string")
    assert sorted((r.sheet, r.quire) for r in U.clean_order(sheets, known).collect()) == [("a", "1"), ("b", "2"), ("c", None)]
    orders = spark.createDataFrame([("1", "old"), ("2", "two")], "id string, body string")
    new = spark.createDataFrame([("1", "new"), ("3", "three")], "id string, body string")
    out, versions = U.replace_by_id(orders, new, spark.createDataFrame([("1", "older", 1)], "id string, body string, age int"))
    assert {r.id: r.body for r in out.collect()} == {"1": "new", "2": "two", "3": "three"}
    assert [(r.body, r.age) for r in versions.orderBy("age").collect()] == [("old", 1), ("older", 2)]
    assert U.upsert(orders.withColumnRenamed("id", "name"), new.withColumnRenamed("id", "name")).count() == 3
    both = U.restored(spark.createDataFrame([("k", ""), ("m", "x")], "key string, value string"), spark.createDataFrame([("k", "v")], "key string, value string"), "key")
    assert {r.key: r.value for r in both.collect()} == {"k": "v", "m": "x"}
    crops = spark.createDataFrame([("old", [(1.0, 2.0), (3.0, 4.0)], False)], "panel string, corners array<struct<x:double,y:double>>, done boolean")
    moved = U.migrate_crops(crops, spark.createDataFrame([("old", "new", 1.0, 0.5)], "panel string, into string, edge double, dx double"))
    got = {r.panel: ([c.x for c in r.corners], r.done) for r in moved.collect()}
    assert got == {"old": ([1.0, 3.0], True), "new": ([1.5, 3.0], False)}
    assert [r.page for r in U.clean_bookmarks(spark.createDataFrame([("p", "n", 1), ("p", "m", 2), ("z", "", 3)], "page string, note string, ord int"), spark.createDataFrame([("p",)], "page string")).collect()] == ["p"]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_more_edits_of_a_book():
    book = {"gatherings": [{"quire": "1", "type": "nested", "bifolia": ["a", "b", "c"]}, {"quire": "2", "type": "nested", "bifolia": ["d", "e"]}, {"quire": "3", "type": "nested", "bifolia": ["f"]}], "unplaced": []}
    rows = lambda b: [g["bifolia"] for g in b["gatherings"]]
    assert rows(O.move_into(book, ["a", "f"], 1)) == [["b", "c"], ["d", "e", "a", "f"]]
    assert O.move_into(book, ["e"], 1) is None
    made = O.group(book, ["c", "d"])
    assert rows(made) == [["a", "b"], ["c", "d"], ["e"], ["f"]] and made["gatherings"][1]["quire"] == "New 1"
    assert rows(O.paste(book, ["a", "e"], "f")) == [["b", "c"], ["d"], ["f", "a", "e"]]
    assert rows(O.paste(book, ["c"], "a")) == [["a", "c", "b"], ["d", "e"], ["f"]]
    assert O.paste(book, ["a"], "a") is None and O.paste(book, ["a"], "none") is None
    turned = O.set_option(book, "b", "rot180", True)
    assert turned["options"] == {"b": {"rot180": True}} and O.set_option(turned, "b", "rot180", True) is None
    assert O.set_option(turned, "b", "rot180", False) == O._copy(book) and O.set_option(book, "b", "other", 1) is None
    assert O.move_into(turned, ["a"], 2)["options"] == turned["options"]
    assert rows(O.move_gathering_to(book, 0, 3)) == [["d", "e"], ["f"], ["a", "b", "c"]] and rows(O.move_gathering_to(book, 2, 0)) == [["f"], ["a", "b", "c"], ["d", "e"]]
    assert O.move_gathering_to(book, 0, 1) is None and "options" not in book


def test_inheritance_of_any_depth(spark):
    n = 14
    orders = spark.createDataFrame([("o0", None)] + [(f"o{i}", f"o{i - 1}") for i in range(1, n)], "order_id string, base string")
    sheets = spark.createDataFrame([(f"o{i}", 1, f"q{i}", "nested", 1, f"s{i}") for i in range(n)], "order_id string, gi int, quire string, type string, pos int, sheet string")
    told = O.resolve(orders, sheets).filter(f"order_id = 'o{n - 1}'")
    assert {r.sheet for r in told.collect()} == {f"s{i}" for i in range(n)}
    with pytest.raises(ValueError):
        O.resolve(spark.createDataFrame([("a", "b"), ("b", "a")], "order_id string, base string"), sheets)


def test_perspective_takes_corners_to_corners():
    corners = [(1.0, 2.0), (11.0, 3.0), (12.0, 9.0), (0.0, 8.0)]
    m = G.perspective(corners, 4, 2)
    for (x, y), want in zip([(0, 0), (4, 0), (4, 2), (0, 2)], corners):
        p = m @ [x, y, 1]
        assert (p[0] / p[2], p[1] / p[2]) == pytest.approx(want)
