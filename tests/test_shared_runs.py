import random

import duckdb

from glyphmill.catalog import ORACLES
from glyphmill.operators import tokens as T
from glyphmill.sources import corpus as C

WORDS = ["the", "of", "oust", "tion", "and", "a", "there"]


def documents(spark):
    rng = random.Random(5)
    first = ["oust", "the", "tion", "of", "the", "the", "and", "there", "oust", "zeal", "quip"]
    rows = [(0, " ".join(first) + "\n" + " ".join(first[2:5]))]
    for i in range(1, 120):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(0, 7))) + rng.choice(("", "", "|")) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, " ".join(first)) for i in range(3)] + [(300, "oust the tion\nof the the\nand there oust the"), (301, "of, the"), (302, None), (303, ""), (310, "a zeal, quip a\nzeal"), (311, "a zeal\nquip a")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_shared_runs_equal_sql_and_cut_only_lines_with_a_word(spark):
    docs = documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.execute("create table labels as select 0 as doc_id, 1 as quality, 0 as toxic")
    sql = ORACLES["shared_runs"].replace("coalesce(source, '–')", "'–'").replace("cast(n_chars // 1000 as varchar)", "'0'")
    lines = C.split_lines(docs)
    for top in (12, 1000):
        want = con.execute(sql.replace("limit 12", f"limit {top}")).fetchall()
        got = T.shared_runs(lines, (0, 0), top)
        assert [(*r[:5], round(r[5], 5)) for r in got.collect()] == [(*r[:5], round(r[5], 5)) for r in want]
    assert len(want) > 20 and {r[4] for r in want} >= {2, 3, 11}
    # places come from windows over lines, not over words: words are cut above the first window by page
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("lead(kind")
    assert "unboundedfollowing" not in plan
