"""Queries of the token index."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.operators import tokens as T
from glyphmill.sources import corpus as C
from glyphmill.sources.corpus import LOCI_SQL, TOKENS_SQL

ON_SQL = f"""with {LOCI_SQL}, {TOKENS_SQL},
heads as (select page, num, coalesce(kind = 'P' and lead(kind) over w = 'P' and not lead(ps) over w, false) as runs_on from loci where line <> '' window w as (partition by page order by num)),
tok as (select page, num, kind, ps, wi, s, start, n, wi = 0 as first, wi = n - 1 as last, wi < n - 1 or runs_on as "on" from words join heads using (page, num))"""
IDF_SQL = ON_SQL + """, pages as (select count(distinct page) as pages from tok),
idf as (select s, count(*) as tf, count(distinct page) as df, ln((select pages from pages) / count(distinct page)) as idf from tok group by s)"""


def _tokens(spark, sf_dir):
    return C.tokens(C.loci(spark, sf_dir))


@query(ON_SQL + ' select page, num, wi, s, cast(start as int) as start, first, last, "on" from tok')
def token_index(spark, sf_dir):
    return C.tokens(C.loci(spark, sf_dir), starts=True).select("page", "num", "wi", "s", "start", "first", "last", "on")


FOUND_SQL = ON_SQL + ", f as (select s, count(*) as n from tok where {} group by s) select s, n, cast(row_number() over (order by s = '{}' desc, n desc, s) as int) as row from f"


@query(FOUND_SQL.format("s like 'the%'", "the"))
def find_begins(spark, sf_dir):
    return T.found_words(C.words(C.loci(spark, sf_dir)), "begins", "the")


@query(FOUND_SQL.format("s = 'the'", "the"))
def find_whole(spark, sf_dir):
    return T.found_words(C.words(C.loci(spark, sf_dir)), "whole", "the")


@query(FOUND_SQL.format("contains(s, 'ous')", "ous"))
def find_contains(spark, sf_dir):
    return T.found_words(C.words(C.loci(spark, sf_dir)), "contains", "ous")


@query(FOUND_SQL.format("regexp_full_match(s, 'th(?:c[ktpf]h|[cs]h|[a-z])[a-z]*nt')", "th?*nt"))
def find_wild(spark, sf_dir):
    return T.found_words(C.words(C.loci(spark, sf_dir)), "wild", "th?*nt")


@query(ON_SQL + ', p as (select *, lead(s) over w as t, lead(s, 2) over w as u, lead("on") over w as o from tok window w as (partition by page order by num, wi)) select page, num, wi from p where s = \'of\' and t = \'the\' and "on" and o and u = \'and\'')
def phrase_over_lines(spark, sf_dir):
    return T.phrase_in_lines(C.loci(spark, sf_dir), "of", "the", "and")


@query(ON_SQL + ", p as (select t.*, line, lead(s) over (partition by t.page, t.num order by wi) as nx from tok t join loci l on t.page = l.page and t.num = l.num) select page, num, wi, s || nx as s from p where nx is not null and substring(line, start + length(s) + 1, 1) = ','")
def joined_words(spark, sf_dir):
    return T.joined_words(C.loci(spark, sf_dir))


@query(ON_SQL + """, p as (select *, lag(s) over w as b1, lag(s, 2) over w as b2, lag("on") over w as o1, lag("on", 2) over w as o2, lead(s) over w as a1, lead(s, 2) over w as a2, lead("on") over w as p1 from tok window w as (partition by page order by num, wi)),
c as (select page, num, wi, s, concat_ws(' ', case when o1 and o2 then b2 end, case when o1 then b1 end) as before, concat_ws(' ', case when "on" then a1 end, case when "on" and p1 then a2 end) as after from p where s like 'oust%')
select *, cast(row_number() over (order by case when split_part(after, ' ', 1) = '' then '~' else split_part(after, ' ', 1) end, page, num, wi) as int) as row from c""")
def places_context(spark, sf_dir):
    return T.ordered_places(T.context_in_lines(C.loci(spark, sf_dir), lambda s: s.startswith("oust"), 2), "after")


@query(ON_SQL + """ select count(*) as places, count(*) filter (kind = 'P' and first) as first, count(*) filter (kind = 'P' and last) as last, count(*) filter (kind = 'P' and not first and not last) as inside, count(*) filter (kind <> 'P') as elsewhere,
 count(*) filter (kind = 'P') as kind_p, count(*) filter (kind = 'L') as kind_l, count(*) filter (kind = 'C') as kind_c, count(*) filter (kind = 'R') as kind_r,
 count(*) filter (facts.lang = 'A') as lang_a, count(*) filter (facts.lang = 'B') as lang_b, count(*) filter (section = 'good') as section_good, count(*) filter (section = 'poor') as section_poor from tok left join facts using (page) where s = 'and'""")
def places_sits(spark, sf_dir):
    return T.where_it_sits(_tokens(spark, sf_dir), F.col("s") == "and", C.page_facts(spark, sf_dir))


@query(IDF_SQL + " select * from idf")
def word_tf_df_idf(spark, sf_dir):
    return T.weights(C.words(C.loci(spark, sf_dir)))


SET = ["tion", "that", "there", "inand", "oust"]
SET_SQL = "(values " + ", ".join(f"('{w}')" for w in SET) + ")"


@query(IDF_SQL + f""", m as (select page, w, max(case when s = w then 1.0 else 0.5 end) as share from (select distinct page, s from tok) t join {SET_SQL} v(w) on s = w or (abs(length(s) - length(w)) <= 1 and levenshtein(regexp_replace(s, '[^ -~]', '~', 'g'), w) = 1) group by page, w),
g as (select page, count(*) as n, sum(share * coalesce(idf, 0)) as score from m left join idf on idf.s = w group by page) select page, n, cast(score as double) as score, n / max(n) over () as weight from g""")
def pages_with_set(spark, sf_dir):
    tok = C.words(C.loci(spark, sf_dir))
    return T.pages_with(tok, spark.createDataFrame([(w,) for w in SET], "w string"), T.weights(tok), near=True)


@query(ON_SQL + ", z as (select page, count(*) as n from tok group by page), f as (select s, count(*) as tf from tok where s in ('tion', 'that', 'by') group by s), a as (select count(*) as m from tok) select cast(sum(p) as double) as expected from (select page, product(1 - pow(1 - tf / m, n)) as p from z, f, a group by page)")
def expected_pages(spark, sf_dir):
    return T.expected_pages(C.words(C.loci(spark, sf_dir)), ["tion", "that", "by"])


@query(IDF_SQL + ", q as (select distinct s from tok where page = 6), m as (select page, count(*) as n, sum(idf) as score from (select distinct page, s from tok where page <> 6) join q using (s) join idf using (s) group by page) select page, n, score, n / max(n) over () as weight from m order by score desc, n desc, page limit 10")
def similar_pages(spark, sf_dir):
    return T.similar_pages(C.words(C.loci(spark, sf_dir)), 6)


@query(IDF_SQL + " select s, df from idf where s in (select s from tok where page in (6, 19) group by s having count(distinct page) = 2) order by df, s limit 8")
def shared_page_words(spark, sf_dir):
    return T.shared_words(C.words(C.loci(spark, sf_dir)), 6, 19)


@query(ON_SQL + f", v as (select distinct s from tok) select w, s from v join {SET_SQL} q(w) on abs(length(s) - length(w)) <= 1 and levenshtein(regexp_replace(s, '[^ -~]', '~', 'g'), w) = 1")
def similar_spellings(spark, sf_dir):
    vocabulary = C.words(C.loci(spark, sf_dir)).select("s").distinct()
    return T.near_spellings(spark.createDataFrame([(w,) for w in SET], "w string"), vocabulary)


@query(ON_SQL + """, a as (select page, num, wi, lead(wi) over (partition by page, num, s order by wi) as b from tok), d as (select *, b - wi as stride, wi - row_number() over (partition by page, num, b - wi order by wi) as run from a where b is not null)
select page, num, min(wi) as a, cast(min(wi) + stride as int) as b, count(*) as n from d group by page, num, stride, run""")
def ring_repeats(spark, sf_dir):
    return T.repeats(C.loci(spark, sf_dir))


@query(IDF_SQL + """, l as (select page as p, num as q from loci where line <> '' order by page, num limit 1), own as (select wi as x, s from tok join l on page = p and num = q),
t as (select page, num, wi, s, row_number() over (partition by page order by num, wi) as i, coalesce(sum(case when "on" then 0 else 1 end) over (partition by page order by num, wi rows between unbounded preceding and 1 preceding), 0) as broken from tok),
m as (select t.*, x, idf, i - x as stride from t join own using (s) join idf using (s)),
r as (select *, i - row_number() over (partition by page, broken, stride order by i) as stretch from m),
g as (select page, num, x, wi, row_number() over (partition by page, broken, stride, stretch, num order by i) as nth, count(*) over f as n, round(sum(idf) over f, 6) as weight, min(length(s)) over f as short from r window f as (partition by page, broken, stride, stretch order by i rows between current row and unbounded following)),
b as (select g.*, row_number() over (partition by page, num order by n desc, weight desc, x, wi) as best from g, l where nth = 1 and not (page = p and num = q) and (n >= 3 or n = 2 and weight >= 4 and short >= 3))
select page, num, x, wi, n, weight from b where best = 1 order by n desc, weight desc, page, num limit 12""")
def shared_runs(spark, sf_dir):
    lines = C.loci(spark, sf_dir)
    first = lines.filter("line <> ''").agg(F.min(F.struct("page", "num")).alias("l")).first()["l"]
    return T.shared_runs(lines, (first["page"], first["num"]))


@query(ON_SQL + ", p as (select substring(s, i, 2) as pair, count(*) as n from (select s, unnest(range(1, length(s))) as i from tok where length(s) > 1) group by 1), c as (select *, sum(n) over (order by n desc, pair rows unbounded preceding) as upto, sum(n) over () as m from p) select pair, n, cast(upto / m as double) as share from c where upto - n < 0.995 * m")
def glyph_pairs_cover(spark, sf_dir):
    return T.glyph_pairs(C.words(C.loci(spark, sf_dir)))


@query("select median from (select min(p_size) as median from (select p_size, sum(w) over (order by p_size range unbounded preceding) as upto, sum(w) over () as m from (select p_size, cast(floor(p_retailprice) as bigint) as w from part)) where 2 * upto >= m)")
def weighted_median(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", F.floor("p_retailprice").alias("w"))
    return T.weighted_median(part, "p_size", "w")


@query("select count(*) filter (quality <> prev) as changes from (select quality, lag(quality) over (order by doc_id) as prev from labels where quality is not null)")
def value_changes(spark, sf_dir):
    return T.changes(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "doc_id")


@query("with c as (select *, case when quality is not distinct from lag(quality) over (order by doc_id) and lag(doc_id) over (order by doc_id) is not null then 0 else 1 end as new from labels), r as (select *, sum(new) over (order by doc_id rows unbounded preceding) as run from c) select quality, min(doc_id) as \"from\", max(doc_id) as \"to\", count(*) as n from r group by run, quality")
def section_runs(spark, sf_dir):
    return T.runs(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "doc_id")


@query("select lang from documents group by lang order by count(*) desc, min(doc_id) limit 1")
def mode_first_seen(spark, sf_dir):
    return T.mode_first(C.documents(spark, sf_dir), "lang", "doc_id")


@query(f"with {LOCI_SQL}, o as (select page, row_number() over (order by page) as pos from (select distinct page from loci)), r as (select page, pos, pos - row_number() over (order by pos) as run from o where page in (select doc_id from documents where n_chars > 1500)) select arg_min(page, pos) as low, arg_max(page, pos) as high, count(*) as n from r group by run")
def page_ranges(spark, sf_dir):
    pages = C.documents(spark, sf_dir).filter("n_chars > 1500").select(F.col("doc_id").alias("page"))
    return T.page_ranges(pages, C.binding(C.loci(spark, sf_dir)))


@query(ON_SQL + " select kind, count(distinct (page, num)) as loci, count(*) as words from tok group by kind")
def loci_by_kind(spark, sf_dir):
    return C.words(C.loci(spark, sf_dir)).groupBy("kind").agg(F.count_distinct("page", "num").alias("loci"), F.count("*").alias("words"))
