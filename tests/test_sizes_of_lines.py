"""Contexts and phrases from lines, held against those of tokens."""

import random

from glyphmill.operators import tokens as T
from glyphmill.sources import corpus as C


def test_contexts_and_phrases_in_lines(spark):
    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abc") + rng.choice(".,") for _ in range(rng.randint(0, 4)))[:-1]
    rows = [(p, n, line(), rng.choice("PPPPL"), n == 0 or rng.random() < 0.1) for p in range(20) for n in range(12)]
    lines = spark.createDataFrame(rows, "page long, num int, line string, kind string, ps boolean")
    tok = C.tokens(lines)
    key = lambda d: sorted(map(tuple, d.collect()))
    for reach in (1, 2, 3):
        assert key(T.context_in_lines(lines, lambda s: s == "a", reach)) == key(T.context(tok, tok.s == "a", reach))
    for words in (("a",), ("a", "b"), ("a", "b", "a")):
        assert key(T.phrase_in_lines(lines, *words)) == key(T.phrase(tok, *words).select("page", "num", "wi"))
    # words that aren't near a hit aren't made into rows
    plan = T.context_in_lines(lines, lambda s: s == "a", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_a_near_part_is_the_hit_as_in_sql(spark, tmp_path):
    import duckdb

    from glyphmill import catalog

    # uncertain spaces inside near spellings: whose parts are near as well (tha; thar), and whose parts aren't (th,ar)
    texts = ["tha x", "tha, r x", "a, thar x", "x thar", "th, ar x", "that th, ar"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(length(text) as long) n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("create view labels as select 0 as doc_id, 1 as quality, 0 as toxic")
    want = con.execute(f"select page, num, start, len, match from ({catalog.ORACLES['search_near']}) order by all").fetchall()
    assert sorted(map(tuple, catalog.QUERIES["search_near"](spark, str(tmp_path)).collect())) == want and len(want) == 7
