"""Readers and writers of transcription files and tables."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import corpus, sinks
from glyphmill.sources import transcripts as R

FILE = """#=IVTFF Eva- 2.0
# a remark
<f1r>      <! $Q=A $L=B>
<f1r.1,@P0>       <%>fach<!x>ys.y[k:t]al,{ch}ar<->@169;ol<$>
<f1r.2,+P0;H>     one.two/
/three.four
<f1r.3,=Lx>       <@L=C>a..b.
<f2v>      <! $L=D>
<f2v.1,@P0>       ???.o!r
"""


@pytest.fixture()
def path(tmp_path):
    p = tmp_path / "t.txt"
    p.write_text(FILE, encoding="latin-1")
    return str(p)


def test_whole_files(spark, path):
    rows = R.read_transcripts(spark, path, strict=True).orderBy("line_no").collect()
    assert [(r.page, r.num, r.locator, r.type, r.transcriber) for r in rows] == [("f1r", 1, "@", "P0", None), ("f1r", 2, "+", "P0", "H"), ("f1r", 3, "=", "Lx", None), ("f2v", 1, "@", "P0", None)]
    assert rows[0].words == ["fachys", "ykal", "char", "@169;ol"] and rows[0].seps == [".", ",", "-", ""] and rows[0].para_start and rows[0].para_end
    assert rows[1].words == ["one", "twothree", "four"] and rows[2].words == ["a", "b"] and rows[3].words == ["???", "o!r"]
    assert rows[1].vars == {"Q": "A", "L": "B"} and rows[2].vars == {"Q": "A", "L": "C"} and rows[3].vars == {"L": "D"}
    assert rows[0].comments == ["x"]


def test_faults():
    with pytest.raises(R.FormatError):
        R.parse_file("<f1r.1,@P0> a", strict=False)
    head = "<f1r> <! $L=B>\n"
    with pytest.raises(R.FormatError):
        R.parse_file(head + "<f1r.1,@P0>[a:b", strict=True)
    loci, passed = R.parse_file(head + "<f1r.1,@P0>[a:b\nnonsense\n<f1r.2,@P0>ok")
    assert [x["num"] for x in loci] == [2] and len(passed) == 2
    t = R.take_apart("a[b:c]{de}?")
    assert (t.tokens, t.uncertain, t.ligatures) == (["a", "b", "d", "e", "?"], [(1, ["b", "c"])], [(2, 4)])


def test_coded_lines(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("<f1r> <! $L=B $Q=C>\n<f1r.1,@P0;K> A1C1\n<f1r.1,@P0;P> zz\n<f1r.1,@P0;K> A1.C1\n<f1r.2,@P0;P> A2\n<f1r.3,@P0;Q> A2\n")
    pages, loci = R.read_coded(spark, str(p))
    assert pages.first().vars == {"L": "B", "Q": "C"} and loci.filter("transcriber = 'K'").first().text == "A1.C1"
    got = {(r.witness, r.num): r.text for r in R.read_interlinear(spark, str(p)).collect()}
    assert got == {("LP", 1): "A1.C1", ("LP", 2): "A2"}
    table = tmp_path / "t.bit"
    table.write_text("# x\n<y\nA1 o\nA2  y more\nlone\n")
    assert [(r.code, r.value) for r in R.read_table(spark, str(table)).orderBy("ord").collect()] == [("A1", "o"), ("A2", "y")]


def test_rules(spark):
    d = spark.createDataFrame([("chor<!c>{x},sh%!?z",), ("",)], "t string")
    rules = {"ch": "B1", "c": "C1", "h": "H1", "o": "A1", "r": "C2", "sh": "B2"}
    assert [r[0] for r in d.select(R.to_codes(F.col("t"), rules)).collect()] == ["B1A1C2,B2Z%Z1Z1", ""]
    got = d.select(R.longest_rule(F.col("t"), {"a": "b"}, None)).collect()
    assert got[0][0] is None and got[1][0] == ""
    assert d.select(R.cleaned(F.lit(" a<!x><->b<%> "))).first()[0] == "a-b"


def test_other_tables(spark, tmp_path):
    (tmp_path / "w.xml").write_text('<p><word index="2" x="1">b</word><word index="1">a</word></p>')
    assert [r.text for r in R.read_xml_words(spark, str(tmp_path / "w.xml")).collect()] == ["a", "b"]
    (tmp_path / "r.jsonl").write_text('{"locus":"f1r.2","word":1,"eva":"x"}\n{"locus":"f1r.1","word":0,"eva":"y"}\n')
    row = R.read_readings(spark, str(tmp_path / "r.jsonl")).first()
    assert row.page == "f1r" and [x.eva for x in row.readings] == ["y", "x"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.bin").write_bytes(b"abc")
    good = R.checked(spark, str(tmp_path / "s"), {"a.bin": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", "b.bin": "0"})
    assert {r.file: r.good for r in good.collect()} == {"a.bin": True, "b.bin": False}
    assert R.optional(spark, str(tmp_path / "nothing"), "a int").count() == 0
    tags = spark.createDataFrame([("p", 1, {"L": "A"}), ("p", 2, {}), ("p", 3, {"L": "B"}), ("q", 1, {})], "page string, line_no int, tags map<string,string>")
    assert [r.in_force for r in R.filled_tags(tags).orderBy("page", "line_no").collect()] == [{"L": "A"}, {"L": "A"}, {"L": "B"}, None]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"b', "x,y"), (2, "plain", None)], "row int, a string, b string")
    sinks.write_csv(rows, ["a", "b"], str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["a,b", '"a""b","x,y"', "plain,"]
    loci = spark.createDataFrame([(1, 0, "dy.qo", "P", True, False, "@"), (1, 1, "ol", "P", False, True, "+"), (2, 0, "ar", "L", False, False, "@")], "page long, num int, line string, kind string, ps boolean, pe boolean, loc string")
    out = [r.value for r in sinks.transcription(loci).orderBy("row").collect()]
    assert out == ["<f1>", "<f1.0,@P0>         <%>dy.qo", "<f1.1,+P0>         ol<$>", "<f2>", "<f2.0,@L0>         ar"]
    assert sinks.file_name("Qok* A!").startswith("search-qok-a-") and "| a |" in sinks.markdown([{"a": 1}], ["a"])


def test_lines_of_every_language(spark, tmp_path):
    d = [(1, "The end, é1\nB|c", "en", "s", 10), (2, "Größe, años", "de", None, 10), (3, "и так", None, "s", 10)]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r.page, r.num): (r.line, r.kind) for r in corpus.loci(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("the.end,é", "P"), (1, 1): ("bc", "L"), (2, 0): ("größe,años", "P"), (3, 0): ("и.так", "P")}
    assert {r.page for r in corpus.page_facts(spark, str(tmp_path)).collect()} == {1, 2, 3}
    assert [r.page for r in corpus.loci(spark, str(tmp_path), "de").collect()] == [2] == [r.page for r in corpus.page_facts(spark, str(tmp_path), "de").collect()]


def test_stored_lines_prune_and_follow_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "RANGE_ROWS", 10)
    d = spark.createDataFrame([(i, f"line {chr(97 + i % 26)}\n\nend" if i % 7 else None) for i in range(100)], "doc_id long, text string")
    path = str(tmp_path / "lines")
    corpus.store_lines(d, path)
    known = {r.page: r for r in corpus.pages_with_data(spark, path).collect()}
    assert set(known) == {i for i in range(100) if i % 7} and known[1].lines == 3 and known[1].written == 2
    assert len({r.range for r in known.values()}) == 10
    some = corpus.lines_of(spark, path, [3, 4, 98])
    assert {(r.page, r.num, r.line) for r in some.collect()} == {(p, n, t) for p in (3, 4) for n, t in ((0, f"line.{chr(97 + p)}"), (1, ""), (2, "end"))}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range#", plan) and re.search(r"PushedFilters: \[[^\]]*In\(page", plan)
    assert "range" not in some.columns and corpus.read_lines(spark, path).count() == sum(r.lines for r in known.values())
    table = str(tmp_path / "documents.parquet")
    for n in (3, 5):  # a table that changed is read anew
        d.limit(n).coalesce(1).write.mode("overwrite").parquet(table)
        assert corpus.loci(spark, str(tmp_path)).select("page").distinct().count() == n - 1


def test_numbers_over_ranges_equal_one_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(300)], "a int, b int").withColumn("u", F.monotonically_increasing_id())
    got = corpus.numbered_by(rows, "row", "b", "a", "u", parts=7).collect()
    assert [r.row for r in sorted(got, key=lambda r: (r.b, r.a, r.u))] == list(range(1, 301))
    assert corpus.numbered_by(rows.filter("false"), "row", "a").count() == 0


def test_places_of_words(spark):
    lines = spark.createDataFrame([(1, 0, "ab.c,größe.x", "P", True), (1, 1, "", "P", False), (2, 0, "и" * 3, "L", True)], "page long, num int, line string, kind string, ps boolean")
    got = {(r.page, r.wi): (r.s, r.start, r.n) for r in corpus.placed_words(lines).collect()}
    assert got == {(1, 0): ("ab", 0, 4), (1, 1): ("c", 3, 4), (1, 2): ("größe", 5, 4), (1, 3): ("x", 11, 4), (2, 0): ("иии", 0, 1)}


def test_tables_of_sources_are_kept_made_anew_and_forgotten(spark, tmp_path):
    from glyphmill.sources import cached

    source, made = tmp_path / "in", []
    spark.range(3).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(str(source))

    def write(path):
        made.append(path)
        if len(made) == 3:
            raise OSError("the source is away")
        spark.read.parquet(str(source)).write.parquet(path)

    count = lambda: spark.read.parquet(cached.table_of(spark, str(source), "copy", write)).count()
    assert count() == 3 and count() == 3 and len(made) == 1
    # a file in a folder within the folder
    spark.range(5).coalesce(1).write.mode("append").parquet(str(source / "part=0"))
    assert count() == 8 and len(made) == 2
    # a load that fails is tried again; one that keeps failing is forgotten
    spark.range(1).coalesce(1).write.mode("append").parquet(str(source / "part=1"))
    assert count() == 9 and len(made) == 4
    spark.range(1).coalesce(1).write.mode("append").parquet(str(source / "part=1"))
    with pytest.raises(ZeroDivisionError):
        cached.table_of(spark, str(source), "copy", lambda path: 1 / 0)
    assert count() == 10 and len(made) == 5
    old = made[-1]
    assert cached.release(spark, str(source)) == 1 and cached.release(spark, str(source)) == 0
    assert count() == 10 and made[-1] != old


def test_a_row_that_reads_like_the_header_is_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nx,y\nx,y\n")
    (tmp_path / "b.csv").write_text("3,\n")
    assert sorted(map(str, (tuple(r) for r in R.read_csv(spark, str(tmp_path), ["x", "y"]).collect()))) == sorted(map(str, [("1", "2"), ("x", "y"), ("x", "y"), ("3", None)]))
