"""Queries of the pattern search."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.operators import search as S
from glyphmill.plans.language import Reading, compile_query, parse
from glyphmill.sources import corpus as C
from glyphmill.sources.corpus import LOCI_SQL, TOKENS_SQL

SPACE = Reading(sp="space")
HIT = ("page", "num", "start", "len", "match")
HITS_SQL = f"with {LOCI_SQL}, {TOKENS_SQL} select page, num, cast(start as int) as start, cast(length(s) as int) as len, s as match from words where "


def _hits(spark, sf_dir, text, reading=SPACE):
    lines = C.loci(spark, sf_dir)
    needs = {k for k, _ in parse(text).filters}
    facts = C.page_facts(spark, sf_dir) if needs & {"scribe", "section", "lang", "quire"} else None
    order = C.binding(lines) if "page" in needs else None
    sets = _sets(spark, sf_dir) if "set" in needs else None
    return S.search(lines, text, reading, facts, order, sets)


def _sets(spark, sf_dir):
    """One named page set: documents of more than 3,000 characters."""
    return C.documents(spark, sf_dir).filter("n_chars > 3000").select(F.lit("long").alias("name"), F.col("doc_id").alias("page"))


@query(HITS_SQL + "s = 'the'")
def search_whole_word(spark, sf_dir):
    return _hits(spark, sf_dir, "the").select(*HIT)


@query(HITS_SQL + "s like 'tion%'")
def search_prefix(spark, sf_dir):
    return _hits(spark, sf_dir, "tion*").select(*HIT)


@query(HITS_SQL + "s like '%ble'")
def search_suffix(spark, sf_dir):
    return _hits(spark, sf_dir, "*ble").select(*HIT)


@query(HITS_SQL + "s like '%onth%'")
def search_contains(spark, sf_dir):
    return _hits(spark, sf_dir, "*onth*").select(*HIT)


@query(f"""with {LOCI_SQL}, {TOKENS_SQL}, p as (select *, lead(s) over (partition by page, num order by wi) as t from words)
select page, num, cast(start as int) as start, cast(length(s) + 1 + length(t) as int) as len from p where s = 'of' and t = 'the'""")
def search_phrase(spark, sf_dir):
    return _hits(spark, sf_dir, "of the").select("page", "num", "start", "len")


@query(f"""with {LOCI_SQL}, {TOKENS_SQL}, c as (select *, case when s = lag(s) over w then 0 else 1 end as new from words window w as (partition by page, num order by wi)),
r as (select page, num, sum(new) over (partition by page, num order by wi) as run from c), n as (select page, num, run, count(*) as n from r group by all)
select page, num, cast(sum(n // 2) as bigint) as hits from n group by page, num having sum(n // 2) > 0""")
def search_repeat(spark, sf_dir):
    return _hits(spark, sf_dir, "A A").groupBy("page", "num").agg(F.count("*").alias("hits"))


@query(HITS_SQL + "wi = 0 and s like 'th%'")
def search_anchor_first(spark, sf_dir):
    return _hits(spark, sf_dir, "^th*").select(*HIT)


@query(HITS_SQL + "wi = n - 1 and s like '%ing'")
def search_anchor_last(spark, sf_dir):
    return _hits(spark, sf_dir, "*ing$").select(*HIT)


@query(HITS_SQL + "regexp_full_match(s, '[tw](?:ch|sh|[a-z])(?:o|a|y)[^.,]*')")
def search_set_class(spark, sf_dir):
    return _hits(spark, sf_dir, "[tw]?<loop>*").select(*HIT)


@query(f"with {LOCI_SQL} select page, num, cast(len(regexp_extract_all(line, 't,?h,?e[.,]?a,?n')) as bigint) as hits from loci where regexp_matches(line, 't,?h,?e[.,]?a,?n')")
def search_join_either(spark, sf_dir):
    return _hits(spark, sf_dir, "the~an", Reading()).groupBy("page", "num").agg(F.count("*").alias("hits"))


@query(f"with {LOCI_SQL} select page, cast(sum(len(regexp_extract_all(line, 'th[ei]n+'))) as bigint) as n from loci group by page having sum(len(regexp_extract_all(line, 'th[ei]n+'))) > 0")
def search_regex(spark, sf_dir):
    return S.counts(C.loci(spark, sf_dir), compile_query(parse("/th[ei]n+/")))


@query(HITS_SQL + "regexp_full_match(s, 'th(?:c[ktpf]h|[cs]h|[a-z])')")
def search_any_glyph(spark, sf_dir):
    """? is one glyph: a letter, or two or three that are written as one."""
    return _hits(spark, sf_dir, "th?").select(*HIT)


@query(HITS_SQL + "regexp_full_match(s, '(?:ch|sh)[^.,]*(?:k|t|p|f)')")
def search_class(spark, sf_dir):
    return _hits(spark, sf_dir, "<bench>*<gallows>").select(*HIT)


RARE_SQL = f"with {LOCI_SQL.replace('loci as (', 'plain as (', 1)}, loci as (select * replace (replace(line, 'q', '@169;') as line) from plain), {TOKENS_SQL}"


@query(RARE_SQL + " select page, num, cast(start as int) as start, cast(length(s) as int) as len, s as match from words where s like '@169;u%'")
def search_rare_glyph(spark, sf_dir):
    """The letter q plays a rare glyph."""
    lines = C.loci(spark, sf_dir).withColumn("line", F.replace("line", F.lit("q"), F.lit("@169;")))
    return S.search(lines, "@169;u*", SPACE).select(*HIT)


def _counted(pattern):
    return f"with {LOCI_SQL} select page, num, cast(len(regexp_extract_all(line, '{pattern}')) as bigint) as hits from loci where regexp_matches(line, '{pattern}')"


@query(_counted("o,?n,?t,?h,?e"))
def search_join_none(spark, sf_dir):
    """on-the: run together, but for uncertain spaces."""
    return _hits(spark, sf_dir, "on-the", Reading()).groupBy("page", "num").agg(F.count("*").alias("hits"))


@query(_counted("o,?f[.,]t,?h,?e"))
def search_join_across(spark, sf_dir):
    """of_the: a space of either kind between."""
    return _hits(spark, sf_dir, "of_the", Reading()).groupBy("page", "num").agg(F.count("*").alias("hits"))


@query(_counted("(?:an|in)[.,]the"))
def search_bounded(spark, sf_dir):
    """A search that ends: the walk over a line is given up after so long."""
    hits = S.search(C.loci(spark, sf_dir), "/(?:an|in)[.,]the/", SPACE, seconds=60)
    return hits.groupBy("page", "num").agg(F.count("*").alias("hits"))


@query(f"""with {LOCI_SQL}, h as (select page, num, line, unnest(range(length(line))) as start from loci where regexp_matches(line, 'oo|ee|tt|ss'))
select page, num, cast(start as int) as start, 2 as len, substr(line, cast(start as int) + 1, 2) as match from h where substr(line, cast(start as int) + 1, 2) in ('oo', 'ee', 'tt', 'ss') and substr(line, cast(start as int), 1) <> substr(line, cast(start as int) + 1, 1)
union all select page, num, cast(start as int), 2, substr(line, cast(start as int) + 1, 2) from h where substr(line, cast(start as int) + 1, 2) in ('oo', 'ee', 'tt', 'ss') and start > 0 and substr(line, cast(start as int), 1) = substr(line, cast(start as int) + 1, 1)
  and (length(regexp_extract(substr(line, 1, cast(start as int)), '(o*|e*|t*|s*)$')) % 2 = 0)""")
def search_regex_hits(spark, sf_dir):
    """A group and a numbered reference back to it, with offsets: doubled letters, which don't overlap."""
    return _hits(spark, sf_dir, r"/([oets])\1/").select(*HIT)


@query(f"with {LOCI_SQL}, {TOKENS_SQL}, d as (select distinct unnest(string_split(line, '.')) as w from loci) select w, cast(levenshtein(regexp_replace(replace(w, ',', ''), '[^ -~]', '~', 'g'), 'xwhz') as double) as cost from d where w <> '' and levenshtein(regexp_replace(replace(w, ',', ''), '[^ -~]', '~', 'g'), 'xwhz') <= 2")
def search_near_words(spark, sf_dir):
    """No letter of xwhz has a family, so plain edit distance is the same."""
    return S.near_words(C.loci(spark, sf_dir), "xwhz", 2)


@query(f"""with {LOCI_SQL}, {TOKENS_SQL}, v as (select distinct unnest(string_split(line, '.')) as w from loci),
cand as (select w, replace(w, ',', '') as b from v),
near as (select w from cand where length(b) = 4 and (substr(b, 2) = 'har' or substr(b, 1, 1) || substr(b, 3) = 'tar' or substr(b, 1, 2) || substr(b, 4) = 'thr' or substr(b, 1, 3) = 'tha'
   or regexp_full_match(b, 'th[oay][rs]'))
   or length(b) = 5 and 'thar' in (substr(b, 2), substr(b, 1, 1) || substr(b, 3), substr(b, 1, 2) || substr(b, 4), substr(b, 1, 3) || substr(b, 5), substr(b, 1, 4))
   or b in ('har', 'tar', 'thr', 'tha')),
split as (select w from near where contains(w, ',') and not list_has_any(string_split(w, ','), (select list(w) from near))),
met as (select page, num, line, w, strpos('.' || replace(line, ',', '.') || '.', '.' || replace(w, ',', '.') || '.') as p from loci join split on contains(line, w))
select page, num, cast(start as int) as start, cast(length(s) as int) as len, s as match from words where s in (select w from near)
union all select page, num, cast(p - 1 as int), cast(length(w) as int), w from met where p > 0 and substr(line, cast(p as int), length(w)) = w""")
def search_near(spark, sf_dir):
    """thar has letters with families: o, a, y and r, s, so an edit inside one costs half, and two of them make one.

    A spelling is compared without uncertain spaces, so one with such a space inside may be near as well.
    """
    return _hits(spark, sf_dir, "thar", Reading(sp="space", near=1)).select(*HIT)


@query(HITS_SQL + "regexp_full_match(s, 'n[kt]')")
def search_family(spark, sf_dir):
    return _hits(spark, sf_dir, "nt", Reading(sp="space", eq="family")).select(*HIT)


@query(f"""with {LOCI_SQL}, {TOKENS_SQL} select page, num, cast(start as int) as start, cast(length(s) as int) as len, s as match from words join facts using (page)
where s = 'and' and scribe = 'src3' and lower(section) like '%oo%' and facts.lang = 'A' and try_cast(quire as double) between 0 and 4 and kind = 'P'""")
def search_filters(spark, sf_dir):
    return _hits(spark, sf_dir, "and scribe:src3 section:oo lang:a quire:0-4 in:para").select(*HIT)


@query(HITS_SQL + "s = 'the' and ps and start = 0")
def search_at_para(spark, sf_dir):
    return _hits(spark, sf_dir, "the at:para-start").select(*HIT)


@query(HITS_SQL + "s = 'the' and wi = n - 1")
def search_at_end(spark, sf_dir):
    return _hits(spark, sf_dir, "the at:end").select(*HIT)


@query(HITS_SQL + "s = 'the' and page between (select min(page) from loci where page in (6, 19)) and 19 and (select count(distinct page) from loci where page in (6, 19)) = 2")
def search_page_range(spark, sf_dir):
    return _hits(spark, sf_dir, "the page:19-6").select(*HIT)


@query(HITS_SQL + "s = 'the' and page in (select doc_id from documents where n_chars > 3000)")
def search_page_set(spark, sf_dir):
    return _hits(spark, sf_dir, "the set:long").select(*HIT)


TOLD_SQL = f"with {LOCI_SQL}, {TOKENS_SQL}, told as (select page, num, kind, start, s, scribe, section, facts.lang as lang, quire from words join facts using (page) where s = 'the')"
FACET_SQL = TOLD_SQL + " select facet, value, count(*) as hits from (select unnest(['scribe','section','lang','kind','quire']) as facet, unnest([scribe, section, lang, kind, quire]) as value from told) group by all"


def _told(spark, sf_dir):
    return S.with_facts(_hits(spark, sf_dir, "the"), C.page_facts(spark, sf_dir))


@query(FACET_SQL)
def facet_counts(spark, sf_dir):
    return S.facets(_told(spark, sf_dir))


@query(f"""{TOLD_SQL}, c as ({FACET_SQL[len(TOLD_SQL):]}), f as (select section as value, min(pos) as pos from told join (select page, row_number() over (order by page) as pos from (select distinct page from loci)) using (page) group by section)
select facet, c.value, hits, cast(row_number() over (partition by facet order by case facet when 'section' then pos when 'quire' then coalesce(try_cast(c.value as double), 99) else -hits end, c.value) as int) as row
from c left join f on facet = 'section' and f.value = c.value""")
def facet_rows(spark, sf_dir):
    return S.ranked_facets(_told(spark, sf_dir), C.binding(C.loci(spark, sf_dir)))


@query(f"{TOLD_SQL} select coalesce(section, 'all') as section, coalesce(lang, 'all') as lang, count(*) as hits from told group by grouping sets ((section, lang), (section), (lang), ())")
def facet_grouping_sets(spark, sf_dir):
    told = _told(spark, sf_dir)
    sets = told.groupingSets([["section", "lang"], ["section"], ["lang"], []], "section", "lang")
    return sets.agg(F.count("*").alias("hits")).select(F.coalesce("section", F.lit("all")).alias("section"), F.coalesce("lang", F.lit("all")).alias("lang"), "hits")


@query(f"{TOLD_SQL} select count(*) as hits from told where section = 'good' and kind = 'P'")
def drill_down(spark, sf_dir):
    return S.narrow_steps(_told(spark, sf_dir), [("section", "good"), ("kind", "P")]).agg(F.count("*").alias("hits"))


@query(f"{TOLD_SQL} select count(*) as hits, count(distinct (page, num)) as lines, count(distinct page) as pages from told")
def hit_summary(spark, sf_dir):
    return S.summary(_hits(spark, sf_dir, "the"))


WITNESS_SQL = f"with {LOCI_SQL}, {TOKENS_SQL}, w as (select case page % 3 when 0 then 'ZL' when 1 then 'GC' else 'IT' end as witness, page - page % 3 as page, num, start, s from words)"


def _witnesses(spark, sf_dir):
    """Three documents in a row play three transcribers of one page."""
    lines = C.loci(spark, sf_dir).withColumn("witness", F.element_at(F.array(F.lit("ZL"), F.lit("GC"), F.lit("IT")), (F.col("page") % 3 + 1).cast("int")))
    return lines.withColumn("page", F.col("page") - F.col("page") % 3)


@query(f"{WITNESS_SQL}, n as (select v.witness, count(s) as n from (values ('ZL'), ('GC'), ('IT'), ('RF')) v(witness) left join (select * from w where s = 'tion') h using (witness) group by 1) select min(n) as low, max(n) as high, case when min(n) = max(n) then cast(min(n) as varchar) else min(n) || '–' || max(n) end as said from n")
def witness_range(spark, sf_dir):
    hits = S.search(_witnesses(spark, sf_dir), "tion", SPACE)
    return S.witness_range(hits, spark.createDataFrame([("ZL",), ("GC",), ("IT",), ("RF",)], "witness string"))


@query(f"{WITNESS_SQL}, h as (select *, row_number() over (partition by witness, page, num order by start) as nth from w where s = 'the') select page, num, 'the' as bare, cast(nth as int) as nth, string_agg(witness, ' ' order by witness) as who, cast(min(start) as int) as start from h group by page, num, nth")
def any_witness_merge(spark, sf_dir):
    return S.any_witness(S.search(_witnesses(spark, sf_dir), "the", SPACE))


@query(f"{TOLD_SQL}, o as (select page, row_number() over (order by page) as pos from (select distinct page from loci)), h as (select page, count(*) as n, count(*) filter (section = 'good') as m from told group by page) select page, cast(pos as int) as pos, coalesce(n, 0) as \"all\", coalesce(m, 0) as now from o left join h using (page)")
def page_histogram(spark, sf_dir):
    told = _told(spark, sf_dir)
    return S.histogram(told, C.binding(C.loci(spark, sf_dir)), S.narrow_steps(told, [("section", "good")]))


KWIC_SQL = f"""with {LOCI_SQL}, {TOKENS_SQL}, h as (select page, num, cast(start as int) as start, s, line, regexp_replace(substring(line, start + length(s) + 1), '^[.,]', '') as rt,
reverse(regexp_replace(substring(line, 1, start), '[.,]$', '')) as lf from words join loci using (page, num) where s like 'oust%')
select page, num, start, cast(row_number() over (order by {{}} page, num, start) as int) as row from h"""


def _kwic(spark, sf_dir, by):
    return S.concordance(_hits(spark, sf_dir, "oust*"), by).select("page", "num", "start", "row")


@query(KWIC_SQL.format("rt = '', rt,"))
def kwic_right(spark, sf_dir):
    return _kwic(spark, sf_dir, "right")


@query(KWIC_SQL.format("lf = '', lf,"))
def kwic_left(spark, sf_dir):
    return _kwic(spark, sf_dir, "left")


@query(KWIC_SQL.format("s,"))
def kwic_match(spark, sf_dir):
    return _kwic(spark, sf_dir, "match")


@query(KWIC_SQL.format(""))
def kwic_book(spark, sf_dir):
    return _kwic(spark, sf_dir, "book")


@query(f"with r as ({KWIC_SQL.format('')}), l as (select page, num from r where row = 150) select page, num, start, row from r where row <= 150 or (page, num) in (select page, num from l)")
def paged_results(spark, sf_dir):
    return S.first_rows(_hits(spark, sf_dir, "oust*").select("page", "num", "start"))


@query(f"with {LOCI_SQL}, {TOKENS_SQL}, h as (select page, num, start, s, line, substring(line, start + length(s) + 1) as a, substring(line, 1, start) as b from words join loci using (page, num) where s like 'oust%') select page, num, cast(start as int) as start, case when length(b) > 28 then '…' || right(b, 28) else b end as left_context, case when length(a) > 28 then left(a, 28) || '…' else a end as right_context from h")
def kwic_clipped(spark, sf_dir):
    hits = _hits(spark, sf_dir, "oust*")
    return hits.select("page", "num", "start", S.clipped(S.before(hits), 28, "right").alias("left_context"), S.clipped(S.after(hits), 28, "left").alias("right_context"))


@query(f"with {LOCI_SQL} select page, num, regexp_replace(line, 'th', '<th>', 'g') as marked from loci where line like '%th%'")
def highlight_segments(spark, sf_dir):
    hits = _hits(spark, sf_dir, "/th/").groupBy("page", "num", "line").agg(F.collect_list(F.struct("start", "len")).alias("cuts"))
    cut = hits.withColumn("cut", S.segments(F.col("line"), F.col("cuts")))
    return cut.select("page", "num", F.array_join(F.transform("cut", lambda c: F.when(c["marked"], F.concat(F.lit("<"), c["text"], F.lit(">"))).otherwise(c["text"])), "").alias("marked"))


@query(f"with {LOCI_SQL}, {TOKENS_SQL} select page || '.' || num as locus_id, cast(row_number() over (order by page, num) as int) as row from (select distinct page, num from words where s = 'the')")
def hit_loci(spark, sf_dir):
    from glyphmill.sources.sinks import locus_list

    return locus_list(S.concordance(_hits(spark, sf_dir, "the")))


@query(f"with {LOCI_SQL} select cast(sum(length(line) - length(replace(line, ',', ''))) as bigint) as uncertain, count(*) filter (line = '') as empty, count(*) as lines, count(*) filter (kind = 'L') as labels from loci")
def loci_profile(spark, sf_dir):
    lines = C.loci(spark, sf_dir)
    return lines.agg(F.sum(F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))).cast("long").alias("uncertain"), F.count_if(F.col("line") == "").alias("empty"), F.count("*").alias("lines"), F.count_if(F.col("kind") == "L").alias("labels"))


@query(HITS_SQL + "s = 'the'")
def search_offsets_python(spark, sf_dir):
    """The Arrow batch way of finding offsets; equal to search_whole_word."""
    return S.matches_python(C.loci(spark, sf_dir), compile_query(parse("the"), SPACE, "python")).select(*HIT)
