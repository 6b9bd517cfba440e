"""The query language: what compiles, what fails, what it says, and that Java's and Python's readings agree."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import search as S
from glyphmill.plans.language import QueryError, Reading, compile_query, describe, from_state, page_list, page_ranges, parse, steps, to_state

LINES = [
    (1, 0, "qokeedy.qokeedy,dal.chol,daiin.ot@169;dy", "P", True),
    (1, 1, "dy.qokeedy.daiin.daiin", "P", False),
    (2, 0, "choldaiin", "L", False),
    (3, 0, "okodar.oko,dar.chol.daiin", "C", False),
]
QUERIES = ["A A", "chol~daiin", "chol daiin", "okodar", "ot?dy", "^dy", "daiin$", "qok*", "*dy", "*od*", "[qd]*", "<bench>*", "dy_qo", "ch-ol", "A:qok* A", "@169;", "/qo[kt]e+dy/", "d?l", "A x* A", "*", "o*o*"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "page long, num int, line string, kind string, ps boolean")


def hits(lines, q, **reading):
    return sorted((r.page, r.num, r.start, r.match) for r in S.search(lines, q, Reading(**reading)).collect())


def found(lines, q, **reading):
    return {(p, n) for p, n, _, _ in hits(lines, q, **reading)}


def test_lines_found(lines):
    a, b, c, d = ((1, 0), (1, 1), (2, 0), (3, 0))
    assert found(lines, "A A") == {a, b} == found(lines, "A A", sp="space")
    assert found(lines, "chol~daiin") == {a, c, d} and found(lines, "chol daiin") == {a, d}
    assert [h[3] for h in hits(lines, "okodar")] == ["okodar", "oko,dar"] and len(hits(lines, "okodar", sp="space")) == 1
    assert found(lines, "ot?dy") == {a} and found(lines, "^dy") == {b} and found(lines, "daiin$") == {b, d}
    assert found(lines, "okydar", eq="family") == {d} and not found(lines, "okydar")
    assert len(hits(lines, "daiin", near=1)) == len(hits(lines, "daiin")) and found(lines, "dain", near=1) == {a, b, d}
    assert found(lines, "choldaiin", sp="none") == {a, c, d}


def test_filters(spark, lines):
    facts = spark.createDataFrame([(1, "2", "Balneology", "B", "13"), (2, "3", "Herbal", "A", "x")], "page long, scribe string, section string, lang string, quire string")
    order = spark.createDataFrame([(3, 1), (1, 2), (2, 3)], "page long, pos int")
    sets = spark.createDataFrame([("mine", 2)], "name string, page long")
    go = lambda q: {r.page for r in S.search(lines, q, Reading(), facts, order, sets).collect()}
    every = "*"
    assert go(f"{every} scribe:2") == {1} and go(f"{every} hand:3") == {2} and go(f"{every} lang:b") == {1} and go(f"{every} section:neo") == {1}
    assert go(f"{every} quire:12-14") == {1} and go(f"{every} quire:13") == {1} and go(f"{every} quire:x") == set()
    assert go(f"{every} in:label") == {2} and go(f"{every} in:ring") == {3} and go(f"{every} set:mine") == {2} and go(f"{every} set:none") == set()
    assert go(f"{every} page:f3-1") == {1, 3} and go(f"{every} page:1-3") == {1, 3} and go(f"{every} page:1-9") == set() and go(f"{every} page:2") == {2}
    assert {r.start for r in S.search(lines, "qok* at:para-end").collect()} == {0}
    assert sorted((r.page, r.num) for r in S.search(lines, "daiin at:line-end").collect()) == [(1, 1), (3, 0)]


@pytest.mark.parametrize("text", ["[kt", "<foo", "<foo>", "-qo", "dy-", "Qok", "foo:1", "[k9]", "@12", "a%", "/[/", "/a/ b", "[]", "a--b"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_empty_queries(lines):
    assert compile_query(parse("")) is None and compile_query(parse("scribe:2")) is None
    assert S.search(lines, "in:label").count() == 0


def test_both_dialects_and_both_ways_agree(spark, lines):
    for q in QUERIES:
        for sp in ("either", "space", "none"):
            r = Reading(sp=sp)
            java, python = compile_query(parse(q), r), compile_query(parse(q), r, "python")
            want = []
            compiled = re.compile(python)
            for page, num, line, *_ in LINES:
                at = 0
                while at <= len(line) and (m := compiled.search(line, at)):
                    if m[0]:
                        want.append((page, num, m.start(), m[0]))
                        at = m.end()
                    else:
                        at = m.end() + 1
            for way in (S.matches(lines, java), S.matches_python(lines, python)):
                assert sorted((x.page, x.num, x.start, x.match) for x in way.collect()) == sorted(want), (q, sp)


def test_narrower_queries_find_less(lines):
    n = lambda q: len(hits(lines, q))
    assert n("^qo*") < n("qo*") and n("chol~daiin") >= n("chol daiin") and n("/qo[kt]e+dy/") >= n("qokeedy") > 0


def test_words_and_state():
    say = lambda q: "".join(t for _, t in describe(parse(q)))
    assert say("qok*") == "words that begin with qok" and say("*dy$") == "words that end with dy, last in a line"
    assert say("A A") == "a word A, then the same word A again" and say("dy_qo") == "dy at a word's end, qo starting the next"
    assert from_state(to_state({"q": "qok* A", "near": "1", "sort": "book"}))["q"] == "qok* A" and to_state({"sort": "book"}) == "search"
    assert steps("scribe:2;lang:B") == [("scribe", "2"), ("lang", "B")]


def test_page_lists():
    order = [f"{n}{s}" for n in range(1, 80) for s in "rv"]
    good, bad = page_list("75r–76v, 1r 2v-3r, 999x", order)
    assert len(good) == 7 and bad == ["999x"] and page_ranges(good, order) == "1r, 2v-3r, 75r-76v"
    assert page_list("f3r to 2v", order) == (["2v", "3r"], [])


def test_family_costs(spark):
    from glyphmill.functions.distances import near_cost

    got = [r[0] for r in spark.createDataFrame([("chol",), ("",), ("char",), ("xx",)], "w string").select(near_cost(F.col("w"), "char")).collect()]
    assert got == [1.5, 4.0, 0.0, 4.0]
