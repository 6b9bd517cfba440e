"""Glyph functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import glyphs as G


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_writing(spark):
    assert one(spark, G.write_as(F.lit("A1C1.B9A1"), {"A1": "o", "C1": "r"}, {"A1C1": "OR"})) == "OR?o"
    assert one(spark, G.as_glyphs(F.lit("chol.d,x*"), {"ch": "Ꮳ", "o": "O", "d": "8"})) == "ᏣOl 8·x*"
    assert G.typed(" Qok**Ꮳ!a?", {"Ꮳ": "ch"}) == "qok*cha?"
    assert one(spark, G.line_words(F.lit("a,b..c"))) == ["a", "b", "c"] and one(spark, G.line_words(F.lit("a,b.c"), False)) == ["ab", "c"]
    assert one(spark, G.bare(F.lit("a.@169;,b"))) == "a@b"
    assert [one(spark, f(F.lit("f1r.12"))) for f in (G.page_of, G.number_of, G.short_page)] == ["f1r", "12", "1r.12"]
    assert tuple(one(spark, G.para_marks(F.lit("<%>a")))) == (True, False)
    assert one(spark, G.named_parts(F.lit("Rose/ x"), {"Rose": "Rosettes"})) == "Rosettes / x"
    assert [tuple(x) for x in one(spark, G.code_words(F.lit("A1C1,A2.B1"), False))] == [("A1", 0), ("C1", 0), ("A2", 0), ("B1", 1)]


def test_maps():
    assert G.glyph_map(list("abcd"), list("abxcd")) == [0, 1, 1.5, 2, 3]
    a = G.alphabet({"A1", "B1", "C9"}, {"A1": "1", "B1": "2", "A1B1": "12", "Z1": "?"}, {"A1": "o", "B1": "d"}, {"C9": "od"})
    assert a.pop("search") == {"1": "o", "2": "d"}
    assert a == {"codes": {"A1": "1", "B1": "2", "C9": "12"}, "multi": {"A1B1": "12"}, "approx": ["C9"]}
    both = G.alphabets({"A1"}, {"x": {"A1": "1"}, "y": {"Z1": "*"}}, {"A1": "o"}, {})
    assert both["x"]["codes"] == {"A1": "1"} and both["y"]["codes"] == {"A1": "*"} and both["y"]["approx"] == ["A1"]


def test_tables(spark):
    lines = spark.createDataFrame([("a", "x"), ("a", ""), ("a", None), ("b", "y")], "locus string, text string")
    assert {r.locus: r.n for r in G.present_on(lines).collect()} == {"a": 1, "b": 1}
    facts = spark.createDataFrame([(1, "s"), (2, "t"), (3, "s")], "page long, section string")
    order = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "page long, pos int")
    assert {r.value: r.pages for r in G.facet_pages(facts, order, "section").collect()} == {"s": "3 1", "t": "2"}
    assert {r.section: r.page for r in G.distinct_facts(facts, "section", ["page"]).collect()} == {"s": "1 3", "t": "2"}
    edits = spark.createDataFrame([(k, p, n) for n, (k, p) in enumerate([("x", 1), ("x", 1), ("y", 1), ("x", 2), ("x", 3), ("y", 4)])], "kind string, page int, ord int")
    assert [(r.kind, r.page) for r in G.varied_examples(edits)] == [("x", 1), ("x", 2), ("y", 4)]


def test_late_actions_are_stopped(spark):
    assert G.within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        G.within(spark, 1, lambda: spark.range(10**13).selectExpr("sum(hash(id))").collect())
