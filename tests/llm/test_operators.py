"""The training-data operators against brute force on small fixtures, and on nulls, empty texts, ties and empty tables."""

import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import common, html_extract, language_id, lm_quality, lm_scoring, mixing, near_dedup, packing, quality_rules, sharding, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def fixture(spark):
    """Copies, near copies, short, blank, null and very long texts, a repeated row, null ids and a clashing column."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        w = t.split(" ")
        w[len(w) // 2] = "zz"
        rows += [(100 + i, t.upper(), "en", "src0"), (200 + i, " ".join(w), "fr", "src9"), (300 + i, " ".join(w[: len(w) // 2]), None, None)]
    big = prose(rng, 30_000)
    rows += [(400, None, "en", "src1"), (401, "", None, "src1"), (402, " \n\t", "en", None), (403, "one", "en", "src1"), (404, "One", "de", "src1"), (405, "a b c d", "en", "src2"), (406, "a b c d", "en", "src2"), (407, big, "en", "src2"), (407, big, "en", "src2"), (None, base[0], "en", "src0"), (None, None, None, None), (408, "é ß 漢字 \U0001f600", "de", "src1")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return fixture(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(12)] + [(None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_components_equal_brute_force(docs, empty):
    got = near_dedup.near_components(docs).collect()
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id), r
    assert near_dedup.near_components(empty).count() == 0
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in got if r.kept}
    assert [r.text for r in kept.filter("doc_id is null").collect()] == [None]  # the other row without an id copies document 0


def test_second_round_finds_what_the_first_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FIRST_BANDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = random.Random(5)
    w = prose(rng, 100).split(" ")
    chain = []
    for i in range(8):  # a chain: neighbours link, the ends don't
        w = list(w)
        w[i * 12] = f"new{i}"
        chain.append((i, " ".join(w)))
    got = near_dedup.near_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in chain]
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert all(link(a, b) for a, b in zip(sets, sets[1:])) and not link(sets[0], sets[-1])
    assert {r.component_id for r in got} == {0}


class Counted(common.Workspace):
    """A workspace that remembers the largest number of rows of each table's name."""

    def __init__(self, spark):
        super().__init__(spark)
        self.rows = {}

    def store(self, df, name):
        out = super().store(df, name)
        self.rows[name] = max(self.rows.get(name, 0), out.count())
        return out


def near_copies(n, edits):
    """n copies of one text, each with so many words of its own."""
    rng = random.Random(8)
    base, out = prose(rng, 150).split(" "), []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(len(w)), edits):
            w[k] = f"own{i}"
        out.append((i, " ".join(w)))
    return out


def test_rows_of_a_group_of_near_copies_grow_linearly(spark):
    made = {}
    for n in (1250, 5000):
        ws = Counted(spark)
        got = near_dedup.near_components(spark.createDataFrame(near_copies(n, 2), "doc_id long, text string"), ws=ws)
        assert got.filter("component_id = 0").count() == n
        made[n] = ws.rows
    assert made[5000]["links"] < 6 * 5000
    for name, rows in made[5000].items():
        assert rows <= 5 * max(made[1250][name], 400), (name, made)


def test_pairs_below_the_threshold_are_not_emitted(spark):
    """Copies of which hardly any two link: all pairs are looked at, none comes out of a block."""
    ws = Counted(spark)
    rows = near_copies(600, 9)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), ws=ws).collect()
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if label[a] != label[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == label
    assert ws.rows["links"] < len(rows) * near_dedup.FIRST_BANDS


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    for share in (0.3, 0.6, 0.75, 0.9):
        n = 1000
        k = int(2 * n * share / (1 + share))
        a, b = x[:n], np.concatenate([x[n - k : n], rng.integers(0, 2**63, n - k, dtype=np.uint64)])
        e = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(e - share) < 0.12
    a, b = x[:500], x[300:900]
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(x[:900])).all()


def test_estimate_loses_no_pair_at_the_threshold():
    size, total = near_dedup.REGISTERS, 0
    p = lambda z: -np.log1p(-z * (near_dedup.BASE - 1) / near_dedup.BASE) / np.log(near_dedup.BASE)
    either = p(0.5 - 0.5 * 0.75)  # of sets of one size, how often one's register is above the other's
    log_n = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size + 1)))])
    for more in range(size + 1):
        less = np.arange(size + 1 - more)
        weight = np.exp(log_n[size] - log_n[more] - log_n[less] - log_n[size - more - less] + (more + less) * np.log(either) + (size - more - less) * np.log(1 - 2 * either))
        less, weight = less[weight > 1e-12], weight[weight > 1e-12]
        if len(less):
            k = np.arange(size)[None]
            x, y = (k < more) * np.ones((len(less), 1), int), ((k >= more) & (k < more + less[:, None])).astype(int)
            total += weight[near_dedup.estimate(x, y, np.full(len(less), 500.0), np.full(len(less), 500.0)) < near_dedup.ESTIMATE].sum()
    assert total < 1e-6


def test_word_hashes_know_words_and_bounds():
    import pyarrow as pa

    texts = ["a b", None, "", " \x0b a\x0cb ", "ab", "x"]
    (first, data, off) = next(common.byte_slices(pa.array(texts)))
    h, bounds = common.word_hashes(data, off)
    assert first == 0 and list(np.diff(bounds)) == [2, 0, 0, 2, 1, 1]
    assert list(h[:2]) == list(h[2:4]) and len(set(h)) == 4
    assert [f for f, _, _ in common.byte_slices(pa.array(["x" * 50] * 4), 60)] == [0, 1, 2, 3]


def test_mix_equals_sql(spark, docs, empty, tmp_path):
    plan = mixing.plan(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    got = sorted(map(tuple, plan.select("doc_id", "size", "source_size", "target", "taken").collect()))
    c = duckdb.connect()
    path = str(tmp_path / "d")
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "source").write.parquet(path)
    c.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert got == sorted(c.execute(mixing.ORACLE).fetchall())
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs).collect()))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) + 1
    assert mixing.plan(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_water_level_is_the_fixed_point(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, "e": 400}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    weight, left, free, want = dict(zip(sorted(sizes), (5, 2, 1, 5, 2))), sum(sizes.values()), set(sizes), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
        free -= set(over)
        left = sum(sizes.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_level_and_gapless(spark, docs, empty, hot):
    if hot:  # one text holds most of the bytes
        docs = docs.filter("n_chars < 5000").unionByName(spark.range(3000).select((F.col("id") + 1000).alias("doc_id"), F.lit("same text " * 5).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(50).cast("long").alias("n_chars"), F.lit("x").alias("id")))
    rows = sharding.shard_plan(docs).collect()
    assert len(rows) == docs.count()
    size = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    most = max(r.size for r in rows)
    assert max(size) - min(size) <= 2 * max(most, 0.002 * sum(size) / 8) + 2
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    assert sharding.shard_plan(empty).count() == 0


def base(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    again = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_base_rules_equal_brute_force(spark, docs, empty, labels):
    rng = random.Random(1)
    extra = ["a b c d a b c", "a a a a a a", "x y\n\nx y\n x y\nx y", "é #é *", "a b c " * 60 + "q w e", " ".join(rng.choices("ab", k=400)), "a b \x0b c\x0cd", prose(rng, 300, "ab")]
    more = docs.unionByName(spark.createDataFrame([(900 + i, t, "en", "s", 1, "x") for i, t in enumerate(extra)], DOCS)).filter("doc_id is not null")
    texts = {r.doc_id: r.text for r in more.collect()}
    for r in quality_rules.judged(more, labels).collect():
        want = base(texts[r.doc_id])
        assert tuple(r)[1:6] == want, r
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judged(docs, labels).count() == docs.count()
    assert quality_rules.judged(empty, labels).count() == 0
    none = quality_rules.judged(docs, labels.filter("false")).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_ratio_equals_brute_force(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(quality_rules, "SLOTS", 64)
    import xxhash

    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = one.select("doc_id", "text").collect()
    trusted = {r.doc_id for r in quality_rules.trusted_ids(labels).collect()}
    raw, target, of = [1.0] * 64, [0.0] * 64, {}
    for r in rows:
        words = WORDS.findall(r.text or "")
        for k, w in enumerate(words):
            first = xxhash.xxh64_intdigest(w.encode(), seed=42)
            both = xxhash.xxh64_intdigest(words[k + 1].encode(), seed=first) if k + 1 < len(words) else first
            of.setdefault(r.doc_id, []).extend(((first - (first >> 63 << 64)) % 64, (both - (both >> 63 << 64)) % 64))
    for i, slots in of.items():
        for slot in slots:
            raw[slot] += 1
            target[slot] += i in trusted
    share = [x / sum(raw) for x in raw]
    ratio = [math.log((t + quality_rules.PRIOR * p) / (sum(target) + quality_rules.PRIOR) / p) for t, p in zip(target, share)]
    got = {r.doc_id: r.score for r in quality_rules.judged(one, labels).collect()}
    for i, slots in of.items():
        assert got[i] == pytest.approx(sum(ratio[x] for x in slots) / len(slots), abs=1e-8)


def test_long_repetitive_texts_count_like_short_ones(spark, labels):
    """Thousands of different repeated windows, and texts on both sides of any size, by brute force."""
    rng = random.Random(11)
    part = [prose(rng, n, "abcdefg") for n in (20, 600, 4000)]
    texts = [f"{t} {t}" for t in part] + [f"{t} new {' '.join(t.split()[:40])}" for t in part]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(d, labels).collect():
        assert tuple(r)[1:6] == base(texts[r.doc_id]), r.doc_id


def test_backoff_equals_sql(spark, docs, empty, tmp_path):
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    one.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(c.execute(lm_scoring.ORACLE).fetchall())
    for chunk, shard in ((12_000_000, 4_000_000), (2000, 300)):
        lm_scoring.CHUNK, lm_scoring.SHARD_ENTRIES = chunk, shard
        got = lm_scoring.stupid_backoff(one).withColumn("log10_score", F.round("log10_score", 4)).withColumn("log10_per_word", F.round("log10_per_word", 6))
        assert sorted(map(tuple, got.collect())) == want
    assert lm_scoring.stupid_backoff(docs).count() == docs.count() and lm_scoring.stupid_backoff(empty).count() == 0


def test_language_of_held_out_texts(spark, empty):
    rng = random.Random(2)
    kinds = {"en": "ethoans", "de": "üßenich", "fr": "éàquelo"}
    rows = [(i, prose(rng, rng.randint(3, 60), kinds[lang]), lang, "s", 1, "x") for i, lang in enumerate(sorted(kinds) * 60)]
    rows += [(1000, None, "en", "s", 1, "x"), (1001, "12 34 !", "en", "s", 1, "x"), (1002, "", None, "s", 1, "x"), (None, "the", "en", "s", 1, "x"), (1003, "漢字 \U00020000", None, "s", 1, "x")]
    d = spark.createDataFrame(rows, DOCS)
    got = language_id.identify(d).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == truth[r.doc_id]
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1000, 1001, 1002} <= und and 1003 not in und
    assert language_id.identify(empty).count() == 0
    blind = language_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in blind)
    kept = language_id.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - 4  # 1003 is in none of the known languages


def test_grams_are_distinct_and_whole():
    table = language_id.symbol_table(["abc ABC é"])
    mark = np.zeros(language_id._GRAMS, np.int32)
    a = language_id.grams("Abc, abc", table, mark)
    assert len(a) == len(set(a)) and set(a) == set(language_id.grams("abc  ABC abc", table, mark))
    assert not len(language_id.grams("1 2", table, mark))


def direct_kneser_ney(texts, points):
    """p(last symbol | ORDER - 1 before it) by the textbook's recursion over plain counters."""
    from collections import Counter

    order, other, edge = lm_quality.ORDER, lm_quality._OTHER, lm_quality._EDGE
    place = {p: i + 2 for i, p in enumerate(points)}
    levels = {order: Counter()}
    for t in texts:
        s = [edge] * (order - 1) + [place.get(ord(c), other) for c in t]
        levels[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off = {}
    for k, c in levels.items():
        n = Counter(c.values())
        if min(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            off[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) for i in (1, 2, 3)]
        else:
            off[k] = [0, 0.5, 0.75, 0.9]

    def p(g):
        k = len(g)
        if not k:
            return 2.0**-lm_quality._BITS
        after = [n for h, n in levels[k].items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        free = sum(off[k][min(n, 3)] for n in after)
        n = levels[k][g]
        return (max(n - off[k][min(n, 3)], 0) + free * p(g[1:])) / sum(after)

    return p, place


def test_entropies_equal_direct_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(lm_quality, "PIECE", 70)  # longer texts are scored in pieces
    monkeypatch.setattr(lm_quality, "CHUNK", 400)
    rng = random.Random(4)
    texts = [prose(rng, 30, "abcdé") for _ in range(24)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, "abc zz \U0001f600 " * 30, None), (101, "a", "en"), (102, None, "en"), (103, "", "en")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    learnt = [r.text for r in lm_quality.sample(plain, lab).collect()]
    assert 0 < len(learnt) < 20
    count = {}
    for c in "".join(learnt):
        count[ord(c)] = count.get(ord(c), 0) + 1
    p, place = direct_kneser_ney(learnt, sorted(count, key=lambda c: (-count[c], c)))
    got = {r.doc_id: r for r in lm_quality.entropies(common.Workspace(spark), plain, lab).collect()}
    assert len(got) == len(rows) and got[102].entropy is None and got[103].entropy is None
    for i, t, _ in rows[18:26]:
        s = [0] * 4 + [place.get(ord(c), 1) for c in t]
        bits = -sum(math.log2(p(tuple(s[k : k + 5]))) for k in range(len(t))) / len(t)
        assert got[i].n_chars_scored == len(t) and got[i].entropy == pytest.approx(bits, abs=2e-4), i
    for head in ((0, 0, 0, 0), (2, 3, 4, 2)):
        assert sum(p((*head, x)) for x in range(2**lm_quality._BITS)) == pytest.approx(1, abs=1e-6)


def test_all_trusted_text_trains(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 5, "abcdé") for _ in range(1000)] + [prose(rng, 45_000, "abcdé")]
    assert len(texts[-1].encode()) > 200_000
    plain = spark.createDataFrame([(i, t, "en" if i < 1000 else "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    lab = spark.createDataFrame([(i, 1, 0) for i in range(1001)], "doc_id long, quality int, toxic int")
    even = [r.doc_id for r in lm_quality._ids(lab).filter("pmod(lot, 2) = 0").collect()]
    even += [1000] * (1000 not in even)
    lots = lab.select(F.col("doc_id"), F.lit(0).cast("long").alias("lot"))
    monkeypatch.setattr(lm_quality, "_ids", lambda labels: lots.filter(F.col("doc_id").isin(even)))
    learnt = sorted(r.text for r in lm_quality.training(plain, lab).collect())
    assert len(even) > 450 and learnt == sorted(texts[i] for i in even)
    points = sorted({ord(c) for t in texts for c in t})
    batches = [b for b in plain.select("text").toArrow().to_batches()]
    want, got = {}, {}
    for held in (10**9, 3_000):  # all at once, and given out many times
        told = want if held > 3_000 else got
        for b in lm_quality._count(iter(batches), points, held):
            for name, c in zip(b.column("name").to_pylist(), b.column("c").to_pylist()):
                told[name] = told.get(name, 0) + c
    assert want == got and sum(want.values()) == sum(map(len, texts))


def test_entropies_hold_in_any_number_of_shards(spark, monkeypatch):
    rng = random.Random(9)
    plain = spark.createDataFrame([(i, prose(rng, 40, "abcdé"), "en") for i in range(30)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(lm_quality, "CHUNK", 300)
    few = {r.doc_id: r.entropy for r in lm_quality.entropies(common.Workspace(spark), plain, lab).collect()}
    monkeypatch.setattr(lm_quality, "ENTRIES", 20)
    monkeypatch.setattr(lm_quality, "SLICE", 1)
    many = {r.doc_id: r.entropy for r in lm_quality.entropies(common.Workspace(spark), plain, lab).collect()}
    assert len(few) == 30 and many == pytest.approx(few, abs=1e-6)


def test_quality_keeps_prose_and_drops_noise(spark, empty):
    rng = random.Random(6)
    clean = [(i, prose(rng, 80, "etaoinshr"), "en" if i % 2 else "fr", "s", 1, "x") for i in range(80)]
    noise = [(500 + i, " ".join("".join(rng.choices("#$%&*@QXZ", k=6)) for _ in range(60)), "en", "s", 1, "x") for i in range(10)]
    odd = [(900, None, None, "s", 1, "x"), (901, "", "en", "s", 1, "x"), (None, "the", None, "s", 1, "x")]
    d = spark.createDataFrame(clean + noise + odd, DOCS)
    lab = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_quality.classify(d, lab).collect()}
    assert all(got[r[0]].kept for r in clean) and not any(got[r[0]].kept for r in noise)
    assert not got[900].kept and got[900].perplexity is None and not got[901].kept
    kept = lm_quality.keep_good(d, lab)
    assert kept.columns == d.columns and not {500, 900, 901} & {r.doc_id for r in kept.collect()}
    assert lm_quality.classify(empty, lab).count() == 0 and lm_quality.classify(d, lab.filter("false")).count() == d.count()


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad {i} -->
<div class="ad">Buy {i}</div><aside>See also</aside><article><h1>Title {i}</h1><p>First &amp; only,   {i}
words &#233;&nbsp;x<br>next<p><b>Second {i}<ul><li>one<li>two {i}</ul><div class="comments"><p>I agree {i}</p></div><form><input value="x"><button>Send</button></form></article><footer>&copy; site</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i)) for i in range(24)]
    rows += [(100, None, None), (101, "http://h7.example/x", ""), (102, "bad", "<p>Lone <b>text"), (103, "http://h1.example/c", PAGE.format(i=3)[:-60]), (104, "http://solo.example/", "no markup & more"), (105, "http://h7.example/t", "<html><body><article><p>Cut &am")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(d).collect()}
    assert len(got) == len(rows)
    for i in range(24):
        assert got[i].text == f"Title {i}\nFirst & only, {i} words é x next\nSecond {i}\ntwo {i}"
        assert got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[100].n_chars, got[101].text) == ("", 0, "")
    assert got[102].text == "Lone text" and got[104].text == "no markup & more" and got[105].text == "Cut &am"
    assert got[103].text == got[3].text
    assert html_extract.extract(d.filter("false")).count() == 0


def deduced(spark, pages):
    """The template of each host, from pages (host, html)."""
    ws = common.Workspace(spark)
    rows = spark.createDataFrame([(i, "u", host, page, i + 1) for i, (host, page) in enumerate(pages)], "page_id long, url string, host string, html string, key long")
    stored = ws.store(rows.mapInArrow(html_extract._parse, html_extract._PARSED), "parsed")
    return {r.host: r for r in html_extract.templates(ws, stored).collect()}


def text_mark(path, text):
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{text}") - 2**63


def test_equal_vectors_make_classes(spark):
    told = deduced(spark, [("h", PAGE.format(i=i)) for i in range(10)])["h"]
    assert told.root == "html:1/body:1/article:1"
    assert text_mark("html:1/body:1/article:1/ul/li", "one") in told.texts


def test_long_template_text_goes(spark):
    notice = "Every reader is asked to keep to the rules of this house. " * 5
    page = "<html><body><article><p>Text {i} of its own.</p><p>" + notice + "</p></article></body></html>"
    d = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i=i)) for i in range(10)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(d).collect()} == {i: f"Text {i} of its own." for i in range(10)}


def test_packing_keeps_every_rule(spark, docs, empty):
    rows = packing.pack(docs).collect()
    texts = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert sum(r.n_words for r in rows) == sum(len(WORDS.findall(t or "")) for _, _, t in texts)
    bins = {}
    for r in rows:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.offset)
        assert rs[0].offset == 0 and all(a.offset + a.n_words == b.offset for a, b in zip(rs, rs[1:])) and rs[-1].offset + rs[-1].n_words <= packing.CAPACITY
        assert max(sum(x.source == r.source for x in rs) for r in rs) <= 2
        ids = [r.doc_id for r in rs]
        assert not {405, 406} <= set(ids) and ids.count(407) <= 1
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_bin_that_fits():
    rng = random.Random(8)
    n = 120
    sizes, sources, clusters = [rng.randint(1, 60) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)], [rng.randint(0, 80) for _ in range(n)]
    got = packing.best_fit(sizes, sources, clusters, 100)
    held: list[list[int]] = []
    for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
        fits = [(100 - sum(sizes[k] for k in b), j) for j, b in enumerate(held) if 100 - sum(sizes[k] for k in b) >= sizes[i] and all(clusters[k] != clusters[i] for k in b) and sum(sources[k] == sources[i] for k in b) < 2]
        if fits:
            j = min(fits)[1]
        else:
            j = len(held)
            held.append([])
        assert got[i] == (j, sum(sizes[k] for k in held[j]))
        held[j].append(i)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(12, 16))
        for k, c in enumerate(centres):
            for j in range(k):
                rows.append((len(rows), [float(x) for x in c + rng.normal(size=16) * 0.09], label))
    rows += [(900 + i, rows[0][1], 0) for i in range(300)]
    rows += [(2000, [2 * x for x in rows[0][1]], 0), (2001, rows[0][1], None), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [float("nan")] * 16, 0), (2005, [None] * 16, 0), (2006, rows[0][1][:8], 0), (None, rows[0][1], 0), (2007, [], 0), (2008, [float("inf")] + [0.0] * 15, 0), (900, rows[0][1], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1))
    got = vector_dedup.near_vectors(d).collect()
    assert len(got) == len(rows)
    sound = [k for k, (i, v, la) in enumerate(rows) if i is not None and v and la is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {k: 0 for k in range(len(rows))}, {rows[k][0]: rows[k][0] for k in sound}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in sound:
        for y in sound:
            if x != y and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1]), np.array(rows[y][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[x] += 1
                    p, q = sorted((root(rows[x][0]), root(rows[y][0])))
                    parent[q] = p
    want = sorted((str(rows[k][0]), links[k], str(root(rows[k][0]) if rows[k][0] in parent else rows[k][0])) for k in range(len(rows)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert vector_dedup.near_vectors(d.filter("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    ws = common.Workspace(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 100), (300, 200)]
    got = {r.node: r.component for r in common.components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 0 for i in range(30)}, 200: 200, 300: 200}


def test_entities_unescape_like_the_library():
    assert [text for _, _, _, text in html_extract.Page("<p>&lt;a&gt; &middot;</p>").nodes] == [html.unescape("&lt;a&gt; &middot;")]


def site(rng, i, notice, layout="div"):
    """A page without article or main element and with class names that say nothing; and its main text."""
    title, paragraphs = prose(rng, 5), [prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 4))]
    menu = "".join(f'<li><a href="/{k}">{prose(rng, 2)}</a>' for k in range(rng.randint(4, 9)))
    body = f"<h2>{title}</h2><p>{notice}</p>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    talk = "".join(f'<div class="q9"><span class="q8">{prose(rng, 2)}</span><em>said</em><p>{prose(rng, 9)}</p></div>' for _ in range(rng.randint(0, 4)))
    if layout == "div":
        page = f'<html><body><div><ul>{menu}</ul></div><div class="k1"><div class="k2">{body}</div><div class="k7">{talk}</div></div><div class="k3">{prose(rng, 4)}</div><div>{notice * 9}</div></body></html>'
    else:
        page = f'<html><body><table><tr><td>{menu}</td><td>{body}</td></tr><tr><td>{prose(rng, 4)}</td><td>{notice * 9}</td></tr></table></body></html>'
    return (i, f"http://{layout}.example/{i}", page), "\n".join([title, *paragraphs])


NOTICE = "All rights are kept by the keeper of rights, who keeps them where rights are to be kept, for as long as anyone keeps count of them. "


@pytest.mark.parametrize("layout", ["div", "table"])
@pytest.mark.parametrize("n", [7, 8, 30])
def test_deduction_needs_no_names(spark, layout, n):
    rng = random.Random(n)
    made = [site(rng, i, NOTICE, layout) for i in range(n)]
    d = spark.createDataFrame([m[0] for m in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(d).collect()}
    assert got == {m[0][0]: m[1] for m in made}


def test_the_template_decides(spark, monkeypatch):
    """With no texts and slots deduced, the long notice is taken for the article."""
    rng = random.Random(2)
    made = [site(rng, i, NOTICE) for i in range(12)]
    d = spark.createDataFrame([m[0] for m in made], "page_id long, url string, html string")
    empty = "host string, root string, depth int, pages long, texts array<long>, records array<string>"
    monkeypatch.setattr(html_extract, "templates", lambda ws, parsed: spark.createDataFrame([], empty))
    got = {r.page_id: r.text for r in html_extract.extract(d).collect()}
    assert sum(got[m[0][0]] != m[1] for m in made) > 8


def test_hosts_of_one_and_two_pages(spark):
    rng = random.Random(5)
    many = [site(rng, i, NOTICE) for i in range(20)]
    alone = [site(rng, 100 + i, "Own notice. ") for i in range(3)]
    rows = [m[0] for m in many] + [(100, "http://one.example/", alone[0][0][2]), (101, "http://two.example/a", alone[1][0][2]), (102, "http://two.example/b", alone[2][0][2])]
    copy = "<html><body><div>a b</div><div>" + "<p>" + prose(rng, 40) + "</p><p>{}</p></div></body></html>"
    rows += [(200, "http://copy.example/a", copy.format("one")), (201, "http://copy.example/b", copy.format("two"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[m[0][0]] == m[1] for m in many)
    for i in range(3):  # nothing tells their notice from their text, but the slot is found
        lines = alone[i][1].split("\n")
        assert got[100 + i] == "\n".join([lines[0], "Own notice.", *lines[1:]])
    assert got[200].endswith("\none") and len(got[200]) > 100  # what two copies share is not a template


def test_occurrence_vectors_equal_brute_force(spark):
    """Texts are template text as the vectors of a small host, counted one by one, say."""
    rng = random.Random(9)
    pages = [site(rng, i, NOTICE)[0] for i in range(9)]
    parsed = [html_extract.Page(p[2]) for p in pages]
    vector = {}
    for k, page in enumerate(parsed):
        for path, _, _, text in page.nodes:
            vector.setdefault((path, text.strip()), [0] * len(pages))[k] += 1
    once = {t for (p, t), v in vector.items() if t and v == [1] * len(pages)}
    found = deduced(spark, [("h", p[2]) for p in pages])
    known = {text_mark(p, t): t for p, t in vector if t}
    # a text is steady if it is once on each of its pages, half of all at least; alone, if its element has no other text
    held = {x: sum(n > 0 for n in v) for x, v in vector.items() if x[1]}
    steady = {x for x, n in held.items() if max(vector[x]) == 1 and n >= max(2, len(pages) / 2)}
    alone = {x for x in steady if all(y in steady and held[y] == sum(y[0] in q.tags for q in parsed) for y in held if y[0] == x[0])}
    alone = {x for x in alone if x[0].startswith(found["h"].root) and not re.match(r"h[1-6]", x[0].split("/")[-1])}
    among = {x for x in steady if x[1] == NOTICE.strip() and x[0].startswith(found["h"].root)}
    assert {text_mark(*x) for x in alone | among} == set(found["h"].texts) and {known[h] for h in found["h"].texts} <= {NOTICE.strip(), "said"}
    containers = {p for p in parsed[0].tags if html_extract._container(p) and all(q.tags.get(p) == 1 for q in parsed)}
    free = {}
    for page in parsed:
        for path, _, link, text in page.nodes:
            if text.strip() and not link and text.strip() not in once:
                free[path] = free.get(path, 0) + len(text)
    assert found["h"].root == html_extract.descend(free, containers)


def test_long_and_deep_pages_take_linear_time(spark):
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        page = html_extract.Page("<div>" * n + "deep" + "</div>" * n + "<b>" * n + "<div>x</div></q>" * n)
        took.append(time.perf_counter() - began)
        assert page.nodes[0][3] == "deep" and max(len(p) for p in page.tags) < 2000
    assert took[1] < 12 * took[0] + 1
    rows = [(1, "http://a.example/", "<div>" * 100_000 + "deep text"), (2, "http://a.example/2", "<p>" + "word " * 400_000)]
    got = {r.page_id: r.n_chars for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: 9, 2: 1_999_999}


def _pages(hosts):
    return [(k, f"http://{h}/{k}", page) for k, (h, page) in enumerate(hosts)]


def _article(k, foot="<div class='x9'>All texts under this roof stay here.</div>"):
    return f"<html><body><div><ul><li><a href='/'>Start</a></li></ul></div><div><h1>Head {k}</h1><p>{prose(random.Random(k), 40)}</p><p>{prose(random.Random(k + 999), 30)}</p>{foot}</div></body></html>"


def test_one_odd_page_leaves_a_hosts_template_alone(spark):
    """Thirty pages with a footer inside the slot, alone, with an empty page, with an error page, and with three odd pages."""
    odd = {"a": [], "b": [""], "c": ["<html><body><p>Not found</p></body></html>"], "d": ["", None, "<p>Gone</p>", "<html><body><div><p>Moved</p></div></body></html>"]}
    hosts = [(h, p) for h, more in odd.items() for p in [*(_article(k + 100 * ord(h)) for k in range(30)), *more]]
    rows = _pages(hosts)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (_, page) in enumerate(hosts):
        if page and "Head" in page:
            assert got[k] == "\n".join(re.findall(r"<h1>(.*?)</h1>", page) + re.findall(r"<p>(.*?)</p>", page)), k
        else:
            assert got[k] in ("", "Not found", "Gone", "Moved")


def test_a_footer_goes_on_hosts_of_two_pages_and_more(spark):
    hosts = [(f"h{n}", _article(k + 50 * n)) for n in (2, 3, 4, 5) for k in range(n)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(_pages(hosts), "page_id long, url string, html string")).collect()}
    assert all("roof" not in t and t.count("\n") == 2 for t in got.values())


def test_copies_on_a_host_keep_their_text(spark):
    """Two pages that differ in their heading and last paragraph alone: what they share is most of the text, so no template."""
    one = prose(random.Random(1), 60)
    page = lambda k: f"<html><body><div><h1>Head {k}</h1><p>{one}</p><blockquote>{one[:100]}</blockquote><p>End {k}.</p></div></body></html>"
    got = [r.text for r in html_extract.extract(spark.createDataFrame(_pages([("h", page(k)) for k in range(2)]), "page_id long, url string, html string")).collect()]
    assert all(one in t and one[:100] in t for t in got)


def test_fixed_texts_equal_a_brute_force_deduction(spark):
    """Over small hosts with one odd page in ten: texts of elements that hold nothing but steady texts on all their pages."""
    rng = random.Random(21)
    hosts = []
    for h in range(6):
        foot = "".join(f"<div class='k{h}'><p>{prose(rng, 5)}</p></div>" for _ in range(rng.randint(0, 2)))
        hosts += [(f"h{h}", "<p>Oh</p>" if rng.random() < 0.1 else _article(rng.randrange(10**6), foot)) for _ in range(rng.randint(2, 12))]
    ws = common.Workspace(spark)
    rows = spark.createDataFrame([(*p, p[1].split("/")[2], 1000 + p[0]) for p in _pages(hosts)], "page_id long, url string, html string, host string, key long")
    found = {r.host: r for r in html_extract.templates(ws, ws.store(rows.mapInArrow(html_extract._parse, html_extract._PARSED), "parsed")).collect()}
    for host in {h for h, _ in hosts}:
        pages = [html_extract.Page(p) for h, p in hosts if h == host]
        of = lambda p: [(path, t.strip()) for path, _, _, t in p.nodes if t.strip()]
        counts = {x: [of(p).count(x) for p in pages] for p in pages for x in of(p)}
        holds = {x: sum(n > 0 for n in c) for x, c in counts.items()}
        steady = {x for x, c in counts.items() if max(c) == 1 and holds[x] >= max(2, len(pages) / 2)}
        fixed = set()
        for path in {x[0] for x in counts}:
            texts, has = [x for x in counts if x[0] == path], sum(path in p.tags for p in pages)
            if all(x in steady and holds[x] == has for x in texts) and not re.match(r"h[1-6]\b", path.split("/")[-1]):
                fixed |= set(texts)
        root = found[host].root if host in found else None
        if root:
            inside = {x for x in fixed if x[0].startswith(root)}
            assert len(set(found[host].texts or ())) >= len(inside), host


@pytest.mark.parametrize(("dim", "size"), [(16, 16), (64, 16), (64, 54), (768, 16), (768, 54)])
def test_lists_are_as_long_in_any_dimension(dim, size):
    """Pairs at cosine 0.98 share a filter, and lists stay short."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    a, b = (vector_dedup.decode(v, *vector_dedup.code(dim, size)) for v in (x, y))
    assert np.mean([len(v) for v in a]) < 64
    assert np.mean([len(np.intersect1d(v, w)) > 0 for v, w in zip(a, b, strict=True)]) >= 0.99
