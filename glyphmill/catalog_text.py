"""Queries of the consensus, spatial and store operators, over driver tables in their roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.operators import consensus as V
from glyphmill.operators import spatial as G
from glyphmill.operators import store as U
from glyphmill.sources import corpus as C
from glyphmill.sources import transcripts as R
from glyphmill.sources.corpus import LOCI_SQL, TOKENS_SQL

WIT = "['ZL','GC','IT','FG','CD','LU','LV','LT','LL','LP','LR','LX']"
# line items play votes: a part is a locus, its size a column, the supplier a transcriber, flag and status the reading
VOTES_SQL = f"""votes as (select l_partkey % 50 as locus, l_linenumber as col, ({WIT})[1 + l_suppkey % 12] as witness, l_suppkey % 12 as rank,
  case when l_quantity = 13 then null else l_returnflag || l_linestatus end as key, case when l_quantity < 10 then 0.5 else 1.0 end as weight,
  case l_shipmode when 0 then '.' when 1 then ',' when 2 then '' when 3 then '-' end as mark
  from (select *, l_orderkey % 5 as l_shipmode from lineitem))"""


def _votes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    who = F.element_at(F.array(*map(F.lit, V.ORDER)), (F.col("l_suppkey") % 12 + 1).cast("int"))
    key = F.when(F.col("l_quantity") == 13, None).otherwise(F.concat("l_returnflag", "l_linestatus"))
    mark = F.element_at(F.create_map(F.lit(0), F.lit("."), F.lit(1), F.lit(","), F.lit(2), F.lit(""), F.lit(3), F.lit("-")), (F.col("l_orderkey") % 5).cast("int"))
    return li.select((F.col("l_partkey") % 50).alias("locus"), F.col("l_linenumber").alias("col"), who.alias("witness"), key.alias("key"), F.when(F.col("l_quantity") < 10, 0.5).otherwise(1.0).alias("weight"), mark.alias("mark"))


@query(f"""with {VOTES_SQL}, e as (select locus, col, key, sum(weight) as v, min(rank) as rank from votes where key is not null group by all),
b as (select *, max(v) over (partition by locus, col) as best from e), n as (select locus, col, count(distinct witness) as voters from votes where key is not null group by all),
t as (select locus, col, arg_min(key, (rank, key)) filter (v = best) as pick, sum(v) as total, max(v) as best, count(*) filter (v = best) as tops, count(*) as readings from b group by all)
select d.locus, d.col, pick, case when readings is null then 'none' when tops > 1 then 'tie' when readings = 1 and voters > 1 then 'unan' when voters = 1 then 'single' when best > total / 2 then 'maj' else 'plur' end as status, cast(best as double) as votes, coalesce(readings, 0) as readings
from (select distinct locus, col from votes) d left join t using (locus, col) left join n using (locus, col)""")
def vote_columns(spark, sf_dir):
    return V.vote_columns(_votes(spark, sf_dir))


@query(f"""with {VOTES_SQL}, t as (select locus, col, sum(case when mark in ('.', '-') then 2 when mark = ',' then 1 else 0 end) as h, count(*) as n, count(*) filter (mark = ',') as commas from votes where mark is not null group by all),
s as (select locus, col, h / (2 * n) as s, case when h = 2 * n then 'all' when 3 * h >= 4 * n then 'most' when 3 * h > 2 * n or commas >= 2 then 'unc' when commas > 0 then 'doubt' when h > 0 then 'few' else 'none' end as status from t)
select locus, col, status, case when status in ('all', 'most') then '.' when status = 'unc' then ',' else '' end as separator, cast(s as double) as s from s""")
def vote_gaps(spark, sf_dir):
    return V.vote_gaps(_votes(spark, sf_dir))


@query(f"""with {VOTES_SQL}, e as (select locus, col, key, sum(weight) as v, min(rank) as rank from votes where key is not null group by all), t as (select locus, col, arg_min(key, (-v, rank, key)) as top from e group by all),
n as (select least(key, top) as a, greatest(key, top) as b, sum(v) as n from e join t using (locus, col) where key <> top group by all having sum(v) >= 10)
select a, b, cast(n as double) as n, round(cast(0.15 + 0.45 * (1 - ln(n) / ln(max(n) over ())) as double), 3) as cost from n""")
def confusion_costs(spark, sf_dir):
    return V.confusion_costs(_votes(spark, sf_dir))


@query("with l as (select conv_id as locus, role as witness from conversations where text is not null and text <> '') select voters, count(*) as loci from (select locus, count(distinct witness) as voters from l group by locus) group by voters")
def coverage(spark, sf_dir):
    return V.coverage(_turns(spark, sf_dir))


@query("select distinct conv_id as locus from conversations where conv_id not in (select conv_id from conversations where role = 'system' and text <> '')")
def loci_missing(spark, sf_dir):
    lines = _turns(spark, sf_dir)
    return V.missing(lines.select("locus").distinct(), lines, "system")


def _turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("locus"), F.col("role").alias("witness"), "text")


PAIRS_SQL = f"with {LOCI_SQL}, pairs as (select page || '.' || num as locus, line as a, lead(line) over (partition by page order by num) as b, page from loci), p as (select * from pairs where b is not null)"


def _pairs(spark, sf_dir):
    """A line and the next of its page play two transcriptions."""
    lines = C.loci(spark, sf_dir)
    return lines.select("page", F.col("locus_id").alias("locus"), F.col("line").alias("a"), F.lead("line").over(Window.partitionBy("page").orderBy("num")).alias("b")).filter("b is not null")


@query(PAIRS_SQL + ", n as (select count(*) as lines, count(*) filter (a = b) as same, count(*) filter (replace(a, ',', '') = replace(b, ',', '')) as joined_same, count(*) filter (regexp_replace(a, '[.,]', '', 'g') = regexp_replace(b, '[.,]', '', 'g')) as same_glyphs from p) select *, round(100 * same / lines, 1) as same_share, round(100 * joined_same / lines, 1) as joined_same_share, round(100 * same_glyphs / lines, 1) as same_glyphs_share from n")
def line_agreement(spark, sf_dir):
    return V.agreement(_pairs(spark, sf_dir))


@query()
def diff_kinds(spark, sf_dir):
    return V.compare(_pairs(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("words"))


@query()
def top_substitutions(spark, sf_dir):
    """The fourteen commonest one-for-one changes: a report, so the limit is its feature."""
    one = V.compare(_pairs(spark, sf_dir)).filter("kind = 'glyphs' and x not like '% %' and y not like '% %'")
    return one.groupBy("x", "y").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "x", "y").limit(14)


@query(PAIRS_SQL + ", s as (select case when page % 2 = 0 then 'even' else 'odd' end as section, page, a <> b as d from p) select coalesce(section, 'all') as section, coalesce(cast(page as varchar), 'all') as page, count(*) as lines, count(*) filter (d) as differ from s group by rollup (section, page)")
def diff_by_section(spark, sf_dir):
    told = _pairs(spark, sf_dir).select(F.when(F.col("page") % 2 == 0, "even").otherwise("odd").alias("section"), F.col("page").cast("string").alias("page"), (F.col("a") != F.col("b")).alias("d"))
    return told.rollup("section", "page").agg(F.count("*").alias("lines"), F.count_if("d").alias("differ")).select(F.coalesce("section", F.lit("all")).alias("section"), F.coalesce("page", F.lit("all")).alias("page"), "lines", "differ")


ALPHABET = V.Alphabet({**{chr(65 + i) + "1": chr(97 + i) for i in range(24)}, "A2": "y", "C2": "z"}, strokes={chr(65 + i) + "1": f"{chr(97 + i % 7)}:{chr(97 + i % 5)}" for i in range(24)})


def _witness_lines(spark, sf_dir):
    """Three spellings of every benchmark passage: as it stands, without every fifth letter, with some swapped."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    code = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == " ", ".").when(x == "", "").otherwise(F.concat(F.upper(x), F.lit("1")))), "")
    bare = F.regexp_replace(F.lower("text"), "[^a-x ]", "")
    ways = F.array(F.struct(F.lit("ZL").alias("w"), bare.alias("t")), F.struct(F.lit("GC").alias("w"), F.regexp_replace(bare, "(....).", "$1").alias("t")), F.struct(F.lit("IT").alias("w"), F.translate(bare, "oe", "ao").alias("t")))
    return b.select(F.col("item_id").cast("string").alias("locus"), F.explode(ways).alias("x")).select("locus", F.col("x.w").alias("witness"), code(F.col("x.t")).alias("text"))


@query()
def consensus_lines(spark, sf_dir):
    told = V.records(_witness_lines(spark, sf_dir), ALPHABET)
    return told.filter("witness = 'ZL'").select("locus", "c", "g", "record")


@query("""with b as (select item_id, regexp_replace(lower(text), '[^a-x ]', '', 'g') as t from benchmark), ways as (select item_id, 'ZL' as witness, t from b union all select item_id, 'GC', regexp_replace(t, '(....).', '\\1', 'g') from b union all select item_id, 'IT', translate(t, 'oe', 'ao') from b)
select item_id || '' as locus, witness, trim(regexp_replace(replace(t, ' ', '.'), '[.]+', '.', 'g'), '.') as line, true as same, false as rough from ways""")
def witness_rebuild(spark, sf_dir):
    """Every witness's line as the record alone gives it back, and whether the record keeps it as rough; here none may be."""
    told = V.records(_witness_lines(spark, sf_dir), ALPHABET)
    tidy = F.btrim(F.regexp_replace(F.replace("rebuilt", F.lit("-"), F.lit(".")), "[.,]*([.,])", "$1"), F.lit(".,"))
    return told.select("locus", "witness", tidy.alias("line"), "same", "rough")


@query()
def aligned_vote(spark, sf_dir):
    return V.vote_columns(V.align_loci(_witness_lines(spark, sf_dir), ALPHABET))


@query("select doc_id, translate(lower(lang), 'abcdefgh', 'hgfedcba') as coded from documents")
def transliterate(spark, sf_dir):
    rules = dict(zip("abcdefgh", "hgfedcba", strict=True)) | {c: c for c in "ijklmnopqrstuvwxyz"}
    return C.documents(spark, sf_dir).select("doc_id", R.longest_rule(F.lower("lang"), rules).alias("coded"))


@query("select doc_id, md5(coalesce(text, '')) as mark, length(text) as n from documents")
def pinned_texts(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"), F.length("text").cast("long").alias("n"))


# parts play boxes: size is the line, price the place
BOX_SQL = "box as (select p_size as page, p_partkey as id, p_retailprice as a, p_retailprice + p_size as b from part)"


def _boxes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size")).alias("b"))


@query(f"with {BOX_SQL} select page, left_id, right_id, round(share, 6) as share from (select l.page, l.id as left_id, r.id as right_id, (least(l.b, r.b) - greatest(l.a, r.a)) / (l.b - l.a) as share from box l join box r on l.page = r.page and least(l.b, r.b) > greatest(l.a, r.a) where l.id % 2 = 0 and r.id % 2 = 1 and least(l.b, r.b) - greatest(l.a, r.a) >= 0.15 * (l.b - l.a))")
def interval_overlap(spark, sf_dir):
    box = _boxes(spark, sf_dir)
    return G.overlaps(box.filter("id % 2 = 0"), box.filter("id % 2 = 1")).withColumn("share", F.round("share", 6))


@query("select c_nationkey as page, c_custkey as id, arg_min(s_suppkey, (d, s_suppkey)) as c, round(min(d), 6) as d from (select c_nationkey, c_custkey, s_suppkey, sqrt((c_acctbal - s_acctbal) ** 2 + (c_custkey - s_suppkey) ** 2) as d from customer join supplier on c_nationkey = s_nationkey) group by 1, 2")
def nearest_centre(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("c"), F.col("s_acctbal").alias("cx"), F.col("s_suppkey").alias("cy"))
    return G.nearest(p, s).withColumn("d", F.round("d", 6))


@query("""with b as (select l_suppkey % 7 as page, l_partkey % 40 as li, 0 as panel, row_number() over (partition by l_suppkey % 7, l_partkey % 40 order by l_orderkey, l_linenumber, l_extendedprice) as wi, case when l_partkey % 40 % 3 = 0 then 'C' else 'P' end as kind,
 l_extendedprice as x, l_quantity as w, l_quantity as h from lineitem), m as (select page, li, panel, median(h) as mid from b group by all), g as (select *, lead(x) over v - (x + w) as gap, lead(wi) over v as next from b window v as (partition by page, li, panel order by wi))
select page, li, panel, wi, next, round(gap, 4) as gap from g join m using (page, li, panel) where gap > case when kind in ('C', 'R') then 8 else 5 end * mid""")
def box_gaps(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page, line = F.col("l_suppkey") % 7, F.col("l_partkey") % 40
    b = li.select(page.alias("page"), line.alias("li"), F.lit(0).alias("panel"), F.row_number().over(Window.partitionBy(page, line).orderBy("l_orderkey", "l_linenumber", "l_extendedprice")).cast("long").alias("wi"), F.when(line % 3 == 0, "C").otherwise("P").alias("kind"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), F.col("l_quantity").alias("h"))
    return G.box_gaps(b).withColumn("gap", F.round("gap", 4))


@query("with f as (select p_size as page, regr_slope(p_retailprice, p_partkey) as slope, regr_intercept(p_retailprice, p_partkey) as \"offset\" from part group by 1) select page, round(slope, 6) as slope, round(\"offset\", 4) as \"offset\", round(max(abs(p_retailprice - slope * p_partkey - \"offset\")), 4) as miss from part join f on p_size = page group by page, slope, \"offset\"")
def frame_fit(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("page"), F.col("p_partkey").cast("double").alias("u"), F.col("p_retailprice").alias("v"))
    return G.frame_fit(p, "page").select("page", F.round("slope", 6).alias("slope"), F.round("offset", 4).alias("offset"), F.round("miss", 4).alias("miss"))


@query("""with p as (select n_nationkey as g, 100.0 + n_nationkey + (10 + n_nationkey) * cos(radians(t * 30)) as x, 50.0 + (10 + n_nationkey) * sin(radians(t * 30)) as y from nation, (select unnest(range(12)) as t))
select g, 100.0 + g as cx, 50.0 as cy, cast(10 + g as double) as r from p group by g""")
def circle_fit(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t"))
    turn, r = F.radians(F.col("t") * 30.0), 10 + F.col("g")
    fit = G.circle_fit(n.select("g", (100.0 + F.col("g") + r * F.cos(turn)).alias("x"), (50.0 + r * F.sin(turn)).alias("y")), "g")
    return fit.select("g", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "r")))


@query(f"""with {LOCI_SQL}, {TOKENS_SQL}, w as (select page, num as li, wi, length(s) as glyphs, start as x0 from words), b as (select *, case when wi % 3 = 0 then cast(x0 * 10 as double) end as x, case when wi % 3 = 0 then glyphs * 9.0 end as w, coalesce(sum(glyphs) over (partition by page, li order by wi rows between unbounded preceding and 1 preceding), 0) as plc from w),
k as (select *, last(case when x is not null then x + w end ignore nulls) over bk as kx, last(case when x is not null then plc + glyphs end ignore nulls) over bk as kg, first(x ignore nulls) over ah as lx, first(case when x is not null then plc end ignore nulls) over ah as lg from b
 window bk as (partition by page, li order by wi rows between unbounded preceding and 1 preceding), ah as (partition by page, li order by wi rows between 1 following and unbounded following)),
r as (select *, (lx - kx) / nullif(lg - kg, 0) as room from k)
select page, li, wi, round(cast(coalesce(x, kx + (plc - kg) * room) as double), 6) as x, round(cast(coalesce(w, glyphs * room) as double), 6) as w, x is null and room is not null as est from r""")
def box_interpolation(spark, sf_dir):
    tok = C.placed_words(C.loci(spark, sf_dir))
    known = F.col("wi") % 3 == 0
    words = tok.select("page", F.col("num").alias("li"), "wi", F.length("s").alias("glyphs"), F.when(known, F.col("start") * 10.0).alias("x"), F.when(known, F.length("s") * 9.0).alias("w"))
    return G.fill_boxes(words, in_order=True)


@query()
def box_matching(spark, sf_dir):
    """Benchmark passages' words against themselves with every seventh dropped."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("page"), F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "text"))
    return G.match_pages(b, b.filter("pos % 7 <> 3"))




@query("""with mine as (select doc_id as id, source || '/' || doc_id // 10 as hash, n_chars from documents where doc_id % 3 = 0), theirs as (select doc_id - 1 as id, source || '/' || doc_id // 10 as hash, n_chars, doc_id as ord from documents where doc_id % 3 <> 0),
a as (select * from theirs where id not in (select id from mine) qualify row_number() over (partition by id order by ord) = 1), b as (select * from a where hash not in (select hash from mine) qualify row_number() over (partition by hash order by ord) = 1)
select id, hash, n_chars from mine union all select id, hash, n_chars from b""")
def import_merge(spark, sf_dir):
    d = C.documents(spark, sf_dir).withColumn("hash", F.concat_ws("/", "source", F.expr("doc_id div 10")))
    mine = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "hash", "n_chars")
    theirs = d.filter("doc_id % 3 <> 0").select((F.col("doc_id") - 1).alias("id"), "hash", "n_chars", F.col("doc_id").alias("ord"))
    return U.skip_known(mine, theirs, ["id"], ["hash"])


@query("select c_custkey, c_mktsegment as quire from (select *, row_number() over (partition by c_custkey % 100 order by c_acctbal, c_custkey) as n from customer) where n = 1")
def first_wins(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("k", F.col("c_custkey") % 100)
    return U.first_of(c.withColumn("o", F.struct("c_acctbal", "c_custkey")), ["k"], "o").select("c_custkey", F.col("c_mktsegment").alias("quire"))


@query("select p_partkey, substring(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) as slug from part")
def slugs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", U.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("select item_id, '\"' || replace(text, '\"', '\"\"') || '\"' as always, case when regexp_matches(text, '[\",\\n]') then '\"' || replace(text, '\"', '\"\"') || '\"' else text end as needed from benchmark")
def csv_cells(spark, sf_dir):
    from glyphmill.sources.sinks import quoted

    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", quoted(F.col("text"), True).alias("always"), quoted(F.col("text")).alias("needed"))


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def events_per_day(spark, sf_dir):
    from glyphmill.streaming.events import per_window

    return per_window(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("value", F.round("value", 4))


@query("""with e as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)), r as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as run from e)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from r group by user_id, run""")
def event_sessions(spark, sf_dir):
    from glyphmill.streaming.events import sessions

    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
