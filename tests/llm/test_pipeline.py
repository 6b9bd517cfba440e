"""The pipeline's stages on a small folder of tables: columns stay, decisions take effect, every stage sees its input."""

import random

import corpus_pipeline
from pyspark.sql.functions import lit

from glyphmill.llm import queries


def folder(spark, path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 6)))
    clean = [" ".join(word() for _ in range(90)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i], "en", "src9", 1) for i in range(5)]
    rows += [(200 + i, "#$%& @@## !!" * 30, "en", "src0", 1) for i in range(3)] + [(300, None, "en", "src0", 0), (301, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    d = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "pack"]
    good = corpus_pipeline.quality(spark, docs, d)
    assert good.columns == docs.columns and ids(good) == sorted([*range(60), *range(100, 105)])
    told = corpus_pipeline.language(spark, good, d)
    assert told.columns == docs.columns and ids(told) == ids(good)
    one = corpus_pipeline.near_duplicates(spark, told, d)
    assert one.columns == docs.columns and ids(one) == list(range(60))
    mixed = corpus_pipeline.mix(spark, one, d)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(range(60))
    out = corpus_pipeline.run(spark, d)
    assert sum(r.n_words for r in out.collect()) == 90 * len(ids(mixed))


def test_repeats_clashing_names_and_missing_ids_come_through(spark, tmp_path):
    d = folder(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    more = docs.unionByName(docs.filter("doc_id in (3, 3, 7)")).unionByName(docs.filter("doc_id = 9").selectExpr("cast(null as bigint) as doc_id", "concat(text, ' and so on')  as text", "lang", "source", "n_chars"))
    clash = {c: lit(c) for c in ("own_id", "OWN_COPIES", "_id", "_own", "component_id", "kept", "score", "lot", "tag", "chunk", "of", "s")}
    more = more.withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, d)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in clash), name
        if name != "mix":
            n = {k: sum(r.doc_id == k for r in rows) for k in (3, 7, 8)}
            assert n == {3: 2, 7: 2, 8: 1}, name
    assert corpus_pipeline.STAGES[-1][1](spark, more, d).count() >= 60


def test_empty_table(spark, tmp_path):
    d = folder(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("false"), d)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name


def test_queries_are_one_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
