"""Queries of the readers, writers, glyph functions, distances, sheet algebra and store, over driver tables in their roles.

Readers are queried by a round trip: driver rows are written as files of the format to the shared folder and read back,
and the oracle says the rows from the driver's tables alone.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.catalog_orders import SHEETS_SQL, SIDES_SQL, _sheets
from glyphmill.catalog_text import ALPHABET, _witness_lines
from glyphmill.functions import distances as D
from glyphmill.functions import glyphs as G
from glyphmill.functions.shipping import shared_folder
from glyphmill.operators import consensus as V
from glyphmill.operators import orders as O
from glyphmill.operators import search as S
from glyphmill.operators import spatial as P
from glyphmill.operators import store as U
from glyphmill.plans.language import Reading
from glyphmill.sources import corpus as C
from glyphmill.sources import sinks as K
from glyphmill.sources import transcripts as R
from glyphmill.sources.corpus import LOCI_SQL, TOKENS_SQL


SPACE = Reading(sp="space")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(column):
    """Letters a to z of a text as words with dots."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z ]", ""), " +", "."), F.lit("."))


WORDS_SQL = "w as (select item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +', '.', 'g'), '.') as line from benchmark)"


# --- readers ---


@query(f"with {WORDS_SQL} select 'f' || item_id as page, 1 as num, 'P0' as type, replace(line, '.', '|') as words, len(string_split(line, '.')) - 1 as breaks, 'A' as q, case when item_id % 2 = 0 then 'k' end as r, true as para_start, item_id % 3 = 0 as para_end, cast(1 as bigint) as notes from w where line <> ''")
def read_transcription(spark, sf_dir):
    """Pages with variables, a tag, a paragraph's marks, a comment, alternatives and a ligature; goes through parser and word splitter."""
    b = _table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("line")).filter("line <> ''")
    head = F.concat(F.lit("<f"), "item_id", F.lit(">      <! $Q=A $L=B>"))
    mark = lambda c, t: F.when(c, t).otherwise("")
    # the first letter stands among alternatives, the next two in a ligature
    body = F.concat(F.lit("["), F.substring("line", 1, 1), F.lit(":z]"), F.regexp_replace(F.substring("line", F.lit(2), F.length("line")), "^([a-z][a-z])", "{$1}"))
    line = F.concat(F.lit("<f"), "item_id", F.lit(".1,@P0>   <%>"), mark(F.col("item_id") % 2 == 0, "<@R=k>"), body, F.lit("<!seen>"), mark(F.col("item_id") % 3 == 0, "<$>"))
    path = _folder(spark, "transcription")
    b.select(F.concat_ws("\n", F.lit("#=IVTFF Eva- 2.0"), head, line)).write.text(path)
    told = R.read_transcripts(spark, path)
    return told.select("page", "num", "type", F.array_join("words", "|").alias("words"), F.size(F.filter("seps", lambda s: s == ".")).cast("long").alias("breaks"), F.col("vars")["Q"].alias("q"), F.col("vars")["R"].alias("r"), "para_start", "para_end", F.size("comments").cast("long").alias("notes"))


@query(f"with {WORDS_SQL} select 'f' || item_id as page, 1 as num, 'H' as transcriber, line as text, 'A' as q from w")
def read_coded_lines(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("line"))
    path = _folder(spark, "coded")
    b.select(F.concat(F.lit("# a remark\n<f"), "item_id", F.lit(">      <! $Q=A>\n<f"), "item_id", F.lit(".1,@P0;H>  old\n<f"), "item_id", F.lit(".1,@P0;H>  "), "line")).coalesce(4).write.text(path)
    pages, loci = R.read_coded(spark, path)
    return loci.join(pages.select("file", "page", F.col("vars")["Q"].alias("q")), ["file", "page"]).select("page", "num", "transcriber", F.btrim("text").alias("text"), "q")


@query("select 'c' || n_nationkey as code, replace(n_name, ' ', '_') as value from nation")
def read_two_columns(spark, sf_dir):
    path = _folder(spark, "table")
    n = _table(spark, sf_dir, "nation")
    n.select(F.concat_ws("\n", F.lit("# code value"), F.concat(F.lit("c"), "n_nationkey", F.lit("   "), F.replace("n_name", F.lit(" "), F.lit("_"))))).coalesce(1).write.text(path)
    return R.read_table(spark, path).select("code", "value")


@query(f"with {WORDS_SQL} select 'f' || item_id as page, 1 as num, line as text from w where line <> ''")
def read_interlinear_lines(spark, sf_dir):
    """Of a letter that isn't a transcriber's nothing comes."""
    voter = next(iter(R.VOTER_LETTERS))
    b = _table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("line")).filter("line <> ''")
    path = _folder(spark, "interlinear")
    b.select(F.concat(F.lit("<f"), "item_id", F.lit(f".1,@P0;{voter}>  "), "line", F.lit("\n<f"), "item_id", F.lit(".2,@P0;?>  none"))).coalesce(3).write.text(path)
    return R.read_interlinear(spark, path).select("page", "num", F.btrim("text").alias("text"))


@query("select cast(n_nationkey as int) as index, n_name as text from nation")
def read_word_elements(spark, sf_dir):
    path = _folder(spark, "xml")
    _table(spark, sf_dir, "nation").select(F.concat(F.lit('<page><word id="w" index="'), "n_nationkey", F.lit('">'), "n_name", F.lit("</word></page>"))).coalesce(2).write.text(path)
    return R.read_xml_words(spark, path).select("index", "text")


@query("select 'f' || n_regionkey as page, count(*) as words, string_agg(lower(n_name), ' ' order by n_nationkey) as evas from nation group by 1")
def read_json_lines(spark, sf_dir):
    path = _folder(spark, "jsonl")
    n = _table(spark, sf_dir, "nation")
    n.select(F.concat(F.lit("f"), "n_regionkey", F.lit(".1")).alias("locus"), F.col("n_nationkey").alias("word"), F.lower("n_name").alias("eva"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("note")).write.json(path)
    told = R.read_readings(spark, path)
    return told.select("page", F.size("readings").cast("long").alias("words"), F.array_join(F.transform("readings", lambda r: r["eva"]), " ").alias("evas"))


@query("select cast(r_regionkey as bigint) as page, count(*) as lines, min(n_name) as first from nation join region on n_regionkey = r_regionkey group by 1")
def write_and_read_pages(spark, sf_dir):
    """One folder of JSON for each page, read back by a schema that is given."""
    path = _folder(spark, "pages")
    K.write_pages(_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), "n_name"), path)
    told = R.read_pages(spark, path, "page long, n_name string", one_each=False)
    return told.groupBy("page").agg(F.count("*").alias("lines"), F.min("n_name").alias("first"))


@query("select c_custkey as id, c_mktsegment as segment, c_name as name from customer where c_mktsegment = 'BUILDING'")
def read_one_partition(spark, sf_dir):
    """Lines by witness in folders of their own: a reader of one witness touches one folder."""
    path = _folder(spark, "witnesses")
    K.write_witnesses(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("witness")), path)
    one = spark.read.parquet(path).filter("witness = 'BUILDING'")
    return one.select(F.col("c_custkey").alias("id"), F.col("witness").alias("segment"), F.col("c_name").alias("name"))


@query(f"with {LOCI_SQL} select page, num, line from loci where page in (3, 7, 11)")
def lines_of_pages(spark, sf_dir):
    path = _folder(spark, "lines")
    C.store_lines(C.documents(spark, sf_dir), path)
    return C.lines_of(spark, path, [3, 7, 11]).select("page", "num", "line")


@query(f"with {LOCI_SQL} select page, count(*) as lines, count(*) filter (line <> '') as written from loci group by page")
def pages_with_data(spark, sf_dir):
    path = _folder(spark, "lines")
    C.store_lines(C.documents(spark, sf_dir), path)
    return C.pages_with_data(spark, path).select("page", "lines", "written")


@query("select item_id, replace(replace(text, chr(13), ' '), chr(10), ' ') as text from benchmark")
def read_csv_rows(spark, sf_dir):
    path = _folder(spark, "csv")
    b = _table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    K.write_csv(b.withColumn("row", F.col("item_id").cast("int") + 1), ["item_id", "text"], path)
    return R.read_csv(spark, path, ["item_id", "text"]).select(F.col("item_id").cast("long").alias("item_id"), "text")


@query("select 'here' as source, r_name as name from region")
def optional_sources(spark, sf_dir):
    """A source that is there and one that isn't."""
    path = _folder(spark, "optional")
    _table(spark, sf_dir, "region").select("r_name").write.json(path)
    told = [R.optional(spark, p, "r_name string").select(F.lit(s).alias("source"), F.col("r_name").alias("name")) for s, p in (("here", path), ("gone", path + "-none"))]
    return told[0].unionByName(told[1])


@query("select r_name as file, r_regionkey <> 3 and r_regionkey <> 4 as good from region")
def pinned_files(spark, sf_dir):
    """Files against pinned sums: of five, one has other bytes and one is missing."""
    path = _folder(spark, "pinned")
    rows = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # five rows
    sums = {r["r_name"]: hashlib.sha256(r["r_name"].encode()).hexdigest() for r in rows}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rows:
        if r["r_regionkey"] != 4:
            where = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['r_name']}")
            out = where.getFileSystem(conf).create(where)
            out.write((r["r_name"] + ("!" if r["r_regionkey"] == 3 else "")).encode())
            out.close()
    return R.checked(spark, path, sums).select("file", "good")


@query("select n_regionkey as page, 1 as num, string_agg(w || '=' || n, ' ' order by w) as told from (select n_regionkey, 'AA' as w, min(n_name) as n from nation group by 1 union all select n_regionkey, 'BB', max(n_name) from nation where n_regionkey <> 2 group by 1) group by 1")
def assembled_witnesses(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    of = lambda f, d: d.groupBy(F.col("n_regionkey").alias("page")).agg(f("n_name").alias("text")).withColumn("num", F.lit(1))
    told = R.by_locus(R.assemble(("AA", of(F.min, n)), ("BB", of(F.max, n.filter("n_regionkey <> 2")))))
    return told.select("page", "num", F.array_join(F.transform(F.array_sort(F.map_entries("texts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("told"))


@query("select cast(l.n as int) as pos, locus, text, locus is not null and text is not null as fits from (select row_number() over (order by n_nationkey) as n, n_name as text from nation) l full join (select row_number() over (order by n_nationkey) as n, 'f' || n_nationkey as locus from nation where n_nationkey < 20) i on l.n = i.n")
def positional_lines(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    return R.positional(C.numbered_by(n.filter("n_nationkey < 20").select("n_nationkey", F.concat(F.lit("f"), "n_nationkey").alias("locus")), "pos", "n_nationkey"), C.numbered_by(n.select("n_nationkey", F.col("n_name").alias("text")), "pos", "n_nationkey"))


@query("select s_suppkey as page, s_name as name, 'https://a.example/' || s_suppkey || '/full/1,/0/x.jpg' as img, 'https://a.example/' || s_suppkey as iiif, cast(null as varchar) as state from supplier where s_suppkey % 2 = 0 union all select s_suppkey, null, null, null, case when s_suppkey % 4 = 1 then 'stale' else 'missing' end from supplier where s_suppkey % 2 = 1")
def model_import(spark, sf_dir):
    """Whitelisted fields with the image service's address; and what is only here or only in the model."""
    s = _table(spark, sf_dir, "supplier").withColumn("page", F.col("s_suppkey"))
    image = F.concat(F.lit("https://a.example/"), "s_suppkey", F.lit("/full/1,/0/x.jpg"))
    model = s.filter("s_suppkey % 2 = 0").select("page", F.col("s_name").alias("name"), image.alias("img"), F.lit("secret").alias("other"))
    own = R.imported(model, ["page", "name", "img", "absent"])
    state = R.stale_and_missing(s.filter("s_suppkey % 4 <> 1").select("page"), s.filter("s_suppkey % 4 <> 3").select("page"))
    none = F.lit(None).cast("string")
    return own.withColumn("state", none).unionByName(state.select("page", none.alias("name"), none.alias("img"), none.alias("iiif"), "state"))


# --- writers ---


@query(f"""with {LOCI_SQL}, {TOKENS_SQL}, h as (select words.page, words.num, words.kind, start, s, line from words join loci using (page, num) where s like 'oust%')
select cast(row_number() over (order by h.page, num, start) as int) as row, h.page || '.' || num as locus, h.page, num as line, kind, left(line, cast(start as int)) as before, s as match, substr(line, cast(start as int) + length(s) + 1) as after, line as text, scribe, section, facts.lang as language, quire from h left join facts on h.page = facts.page""")
def hit_export(spark, sf_dir):
    hits = S.search(C.loci(spark, sf_dir), "oust*", SPACE)
    return K.hit_rows(hits, C.page_facts(spark, sf_dir))


@query("""with r as (select n_regionkey + 1 as row, n_regionkey as region, count(*) as nations, min(n_name) as first from nation group by 1, 2), q as (select row_number() over (order by r_regionkey) as row, r_name as name from region),
l as (select 0 as p, 0 as k, '# Places' as value union all select 0, 1, '' union all select 1, 0, '## Regions' union all select 1, 1, '' union all select 1, 2, '| region | nations | first |' union all select 1, 3, '| --- | --- | --- |' union all select 1, row + 3, '| ' || region || ' | ' || nations || ' | ' || first || ' |' from r
 union all select 2, 0, '## Names' union all select 2, 1, '' union all select 2, 2, '| name |' union all select 2, 3, '| --- |' union all select 2, row + 3, '| ' || name || ' |' from q)
select cast(row_number() over (order by p, k) as int) as row, value from l""")
def report_lines(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    regions = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), F.min("n_name").alias("first")).withColumn("row", F.col("region") + 1)
    names = C.numbered_by(r.select("r_regionkey", F.col("r_name").alias("name")), "row", "r_regionkey")
    return K.report(spark, "Places", [("Regions", regions, ["region", "nations", "first"]), ("Names", names, ["name"])])


@query(f"""with {LOCI_SQL}, l as (select *, row_number() over (partition by page order by num) = 1 as new from loci), v as (
 select page, num, 0 as k, '<f' || page || '>' as value from l where new union all
 select page, num, 1, case when length('<f' || page || '.' || num || ',@' || kind || '0>') < 19 then rpad('<f' || page || '.' || num || ',@' || kind || '0>', 19, ' ') else '<f' || page || '.' || num || ',@' || kind || '0>' end || case when ps then '<%>' else '' end || line from l)
select cast(row_number() over (order by page, num, k) as int) as place, value from v""")
def transcription_lines(spark, sf_dir):
    """The lines of all pages as a transcription file."""
    lines = C.loci(spark, sf_dir).withColumn("pe", F.lit(False)).withColumn("loc", F.lit("@"))
    return C.numbered_by(K.transcription(lines), "place", "row").select("place", "value")


@query("""select '{"name":"' || n_name || '","region":' || n_regionkey || '}' as value from nation""")
def store_export(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit("x").alias("private"))
    return K.store_export(n, ["name", "region", "absent"])


# --- glyph functions ---

CODED_SQL = f"{WORDS_SQL}, coded as (select item_id, line, list_aggregate(list_transform(regexp_extract_all(line, '.'), lambda c: case when c = '.' then '.' else upper(c) || '1' end), 'string_agg', '') as codes from w)"


def _coded(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("line"))
    return b.withColumn("codes", F.array_join(F.transform(F.filter(F.split("line", ""), lambda c: c != ""), lambda c: F.when(c == ".", ".").otherwise(F.concat(F.upper(c), F.lit("1")))), ""))


@query(f"with {CODED_SQL} select item_id, replace(regexp_replace(replace(replace(line, '.', ''), 'th', '@'), '[^@a-n]', '?', 'g'), '@', 'Þ') as written from coded")
def codes_written(spark, sf_dir):
    """Letters a to n by rules for one code, th by a rule for two, the rest unknown."""
    single = {f"{c.upper()}1": c for c in "abcdefghijklmn"}
    return _coded(spark, sf_dir).select("item_id", G.write_as(F.replace("codes", F.lit("."), F.lit("")), single, {"T1H1": "Þ"}).alias("written"))


@query(f"with {WORDS_SQL} select item_id, list_aggregate(list_transform(regexp_extract_all(line, 'ch|.'), lambda x: case x when 'ch' then 'K2' when 'a' then 'A1' when 'c' then 'C1' when '.' then '.' else 'Z1' end), 'string_agg', '') as codes from w")
def letters_to_codes(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<!note>"), _words("text"), F.lit("!")).alias("line"))
    return b.select("item_id", F.coalesce(R.to_codes(F.col("line"), {"ch": "K2", "a": "A1", "c": "C1"}), F.lit("")).alias("codes"))


@query(f"""with {WORDS_SQL} select item_id, regexp_replace(regexp_replace(replace(replace(line, 'sh', '§'), 'ch', '¢'), '[o]', 'ø', 'g'), '\\.', ' ', 'g') as glyphs, array_to_string(list_filter(string_split(line, '.'), lambda x: x <> ''), '|') as words, replace(line, '.', '') as bare, true as start, item_id % 2 = 0 as "end",
 'f' || item_id as page, '1' as number, cast(item_id as varchar) as short, '-' || line as clean, 'Herbal / x / Stars' as section from w""")
def glyph_columns(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("line"))
    locus = F.concat(F.lit("f"), "item_id", F.lit(".1"))
    raw = F.concat(F.lit("<%>"), "line", F.when(F.col("item_id") % 2 == 0, "<$>").otherwise(""))
    marks = G.para_marks(raw)
    return b.select(
        "item_id",
        G.as_glyphs(F.col("line"), {"sh": "§", "ch": "¢", "o": "ø"}).alias("glyphs"),
        F.array_join(G.line_words(F.col("line")), "|").alias("words"),
        G.bare(F.col("line")).alias("bare"),
        marks["start"].alias("start"),
        marks["end"].alias("end"),
        G.page_of(locus).alias("page"),
        G.number_of(locus).alias("number"),
        G.short_page(G.page_of(locus)).alias("short"),
        R.cleaned(F.concat(F.lit("<!a note><->"), "line", F.lit("<$>"))).alias("clean"),
        G.named_parts(F.lit("H / x/S"), {"H": "Herbal", "S": "Stars"}).alias("section"),
    )


@query(f"with {CODED_SQL}, p as (select item_id, unnest(string_split(codes, '.')) as part, generate_subscripts(string_split(codes, '.'), 1) - 1 as word from coded), c as (select item_id, word, unnest(regexp_extract_all(part, '[A-Z]1')) as code from p) select item_id, cast(word as int) as word, code, count(*) as n from c group by all")
def code_word_places(spark, sf_dir):
    told = _coded(spark, sf_dir).select("item_id", F.explode(G.code_words(F.col("codes"), True)).alias("x"))
    return told.groupBy("item_id", F.col("x.word").alias("word"), F.col("x.code").alias("code")).agg(F.count("*").alias("n"))


# --- distances ---

VOCABULARY_SQL = f"{LOCI_SQL}, {TOKENS_SQL}, v as (select distinct s from words where regexp_full_match(s, '[a-z]+'))"


def _vocabulary(spark, sf_dir):
    return C.words(C.loci(spark, sf_dir)).select("s").distinct().filter(F.col("s").rlike("^[a-z]+$"))


@query(f"with {VOCABULARY_SQL} select s, length(s) - 1 + case when contains(s, 'o') then 0.0 when regexp_matches(s, '[ay]') then 0.5 else 1.0 end as cost from v")
def near_costs_family(spark, sf_dir):
    """Against the one letter o, whose family is o, a, y, the cost has a closed form."""
    return _vocabulary(spark, sf_dir).select("s", D.near_cost(F.col("s"), "o").alias("cost"))


@query(f"with {VOCABULARY_SQL}, p as (select s, 'there' as t, levenshtein(s, 'there') as d from v) select s, cast(least(d, 2) as int) as apart, case when s = t then 3 when d / greatest(length(s), length(t)) <= 0.2 then 2 when d / greatest(length(s), length(t)) <= 0.34 then 1 else -2 end as step, 1 - d / greatest(length(s), length(t)) as alike from p")
def spelling_ladders(spark, sf_dir):
    """Short-circuited edits, the match ladder, and the likeness of words without wildcards."""
    alike = F.udf(lambda s: D.likeness(s, "there"), "double", useArrow=True)
    return _vocabulary(spark, sf_dir).select("s", D.spelling_distance(F.col("s"), F.lit("there")).alias("apart"), D.match_ladder(F.col("s"), F.lit("there")).alias("step"), alike("s").alias("alike"))


@query(f"with {VOCABULARY_SQL} select s, least(3, length(s)) as shared, length(s) as longest from v")
def glyph_agreement(spark, sf_dir):
    """A word and its first three letters share those."""
    agree = F.udf(lambda s: D.shared_glyphs(s, s[:3]), "struct<shared:long, longest:long>", useArrow=True)
    return _vocabulary(spark, sf_dir).select("s", agree("s").alias("x")).select("s", "x.shared", "x.longest")


# --- lines of witnesses ---

BARE_SQL = "b as (select item_id, regexp_replace(lower(text), '[^a-x ]', '', 'g') as t from benchmark), ways as (select item_id, 'ZL' as witness, t from b union all select item_id, 'GC', regexp_replace(t, '(....).', '\\1', 'g') from b union all select item_id, 'IT', translate(t, 'oe', 'ao') from b), shown as (select item_id || '' as locus, witness, trim(regexp_replace(replace(t, ' ', '.'), '[.]+', '.', 'g'), '.') as line from ways)"


@query(f"with {BARE_SQL} select locus, witness, line, length(replace(line, '.', '')) as slots from shown")
def witness_lines_shown(spark, sf_dir):
    """Lines of codes in letters, and how many slots they have."""
    line = F.udf(lambda t: V.line_text(t, ALPHABET), "string", useArrow=True)
    slots = F.udf(lambda t: len(V.slots(t)[0]), "long", useArrow=True)
    return _witness_lines(spark, sf_dir).select("locus", "witness", line("text").alias("line"), slots("text").alias("slots"))


@query(f"with {BARE_SQL} select locus, line as c, 0 as units, 0 as gaps from shown where witness = 'ZL' and line <> ''")
def consensus_of_copies(spark, sf_dir):
    """Three equal witnesses have their line for a consensus, and an empty apparatus."""
    one = _witness_lines(spark, sf_dir).filter("witness = 'ZL'")
    each = one.select("locus", F.explode(F.array(*map(F.lit, ("ZL", "GC", "IT")))).alias("witness"), "text")
    told = V.records(each, ALPHABET).filter("witness = 'GC'")
    return told.select("locus", "c", F.size(F.from_json("record", "u array<string>")["u"]).alias("units"), F.size(F.from_json("record", "s array<string>")["s"]).alias("gaps"))


@query(f"with {BARE_SQL}, z as (select locus, replace(line, '.', '') as t from shown where witness = 'ZL'), c as (select locus, unnest(range(length(t))) as col, t from z), l as (select locus, cast(col as int) as col, substr(t, col + 1, 1) as key from c) select locus, col, key as pick, case when key in ('o', 'e') then 'maj' else 'unan' end as status, case when key in ('o', 'e') then 2.0 else 3.0 end as votes, case when key in ('o', 'e') then 2 else 1 end as readings from l")
def vote_of_aligned(spark, sf_dir):
    """Two equal witnesses and one with o and e changed, letter against letter: the changed ones are outvoted."""
    lines = _witness_lines(spark, sf_dir).filter("witness <> 'GC'")
    second = lines.filter("witness = 'ZL'").withColumn("witness", F.lit("GC"))
    told = V.vote_columns(V.align_loci(lines.unionByName(second), ALPHABET))
    return told.select("locus", "col", "pick", "status", F.col("votes"), F.col("readings").cast("int").alias("readings"))


@query(f"with {WORDS_SQL}, d as (select item_id, string_split(line, '.') as a from w), k as (select item_id, a from d where len(a) >= 5 and len(list_distinct(a)) = len(a)) select item_id, 'missing' as kind, a[2] as x, '' as y, 1 as weight from k union all select item_id, 'joined', a[4] || ' ' || a[5], a[4] || a[5], 2 from k")
def known_edits(spark, sf_dir):
    """Passages of different words against themselves without the second, and with the fourth and fifth joined."""
    b = _table(spark, sf_dir, "benchmark").select("item_id", F.split(_words("text"), r"\.").alias("a"))
    k = b.filter((F.size("a") >= 5) & (F.size(F.array_distinct("a")) == F.size("a")))
    dot = lambda c: F.array_join(c, ".")
    second = F.concat(F.slice("a", 1, 1), F.slice("a", 3, 1), F.array(F.concat(F.get("a", F.lit(3)), F.get("a", F.lit(4)))), F.slice("a", 6, F.size("a")))
    return V.compare(k.select(F.col("item_id").cast("string").alias("locus"), dot(F.col("a")).alias("a"), dot(second).alias("b"))).withColumn("locus", F.col("locus").cast("long")).withColumnRenamed("locus", "item_id")


@query("with w as (select n_nationkey as ord, n_regionkey as code, n_nationkey % 3 as num from nation), c as (select code, num, count(*) as n, min(ord) as ord from w group by all) select 'X' || code as code, arg_max('10' || num, (n, -ord)) as \"at\" from c group by code union all select 'Xz', '999'")
def learned_rare(spark, sf_dir):
    """Lines of two words in two encodings; each has one rare glyph, so its number can be learnt; one code has a default only."""
    n = _table(spark, sf_dir, "nation")
    coded = F.array(F.lit("A1B1"), F.concat(F.lit("A1X"), "n_regionkey"))
    basic = F.array(F.lit("ab"), F.concat(F.lit("a@10"), F.col("n_nationkey") % 3, F.lit(";")))
    return V.learn_rare(V.rare_words(n.select(F.col("n_nationkey").alias("ord"), coded.alias("coded"), basic.alias("basic"))), {"Xz": "999", "X0": "000"})


# --- facts of pages ---


@query("select source as value, string_agg(cast(doc_id as varchar), ' ' order by doc_id desc) as pages from documents group by source")
def facet_to_pages(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    return G.facet_pages(d.select(F.col("doc_id").alias("page"), "source"), d.select(F.col("doc_id").alias("page"), (-F.col("doc_id")).alias("pos")), "source")


@query("select conv_id as locus, count(*) filter (coalesce(text, '') <> '') as n from conversations group by conv_id")
def present_on(spark, sf_dir):
    return G.present_on(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("locus"), "text"))


@query("select source, string_agg(distinct lang, ' ' order by lang) as lang from documents group by source")
def facts_of_groups(spark, sf_dir):
    return G.distinct_facts(C.documents(spark, sf_dir), "source", ["lang"])


@query("with r as (select p_size as page, p_retailprice as v, row_number() over (partition by p_size order by p_retailprice) - 1 as k, count(*) over (partition by p_size) as n from part) select page, min(v) filter (k = n // 3) as third from r group by page")
def lower_thirds(spark, sf_dir):
    p = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("page")).agg(F.collect_list("p_retailprice").alias("v"))  # the boxes of one page
    return p.select("page", P.lower_third(F.col("v")).alias("third"))


@query("select p_partkey as id, round(p_retailprice + 5 * cos(radians(p_size)) + 2 * sin(radians(p_size)), 6) as x1, 10.0 as w, 4.0 as h, round(a - 360 * ceil((a - 180) / 360.0), 6) as wrapped from (select *, cast(p_partkey * 7 - 900 as double) as a from part)")
def turned_boxes(spark, sf_dir):
    """The upper right corner of a 10 x 4 box turned by its size in degrees, the box's size again, and an angle wrapped."""
    p = _table(spark, sf_dir, "part")
    corners = P.oriented_corners(F.col("p_retailprice"), F.lit(0.0), F.lit(10.0), F.lit(4.0), F.col("p_size"))
    told = p.select("p_partkey", corners.alias("c"))
    size = P.quad_size(F.col("c"))
    return told.select(F.col("p_partkey").alias("id"), F.round(F.col("c")[1]["x"], 6).alias("x1"), F.round(size["w"], 6).alias("w"), F.round(size["h"], 6).alias("h"), F.round(P.wrapped((F.col("p_partkey") * 7 - 900).cast("double")), 6).alias("wrapped"))


@query("with f as (select p_size as page, regr_slope(p_retailprice, p_partkey) as s, regr_intercept(p_retailprice, p_partkey) as o from part group by 1) select p_size as page, p_partkey as id, round(p_partkey * s + o, 4) as x, round(10 * s, 6) as w from part join f on p_size = page where s is not null and not isnan(s)")
def boxes_transferred(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.col("p_partkey").cast("double").alias("u"), F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("id"))
    fits = P.frame_fit(p, "page").filter("slope is not null")
    return P.transfer(p.select("page", "id", F.col("u").alias("x"), F.lit(10.0).alias("w")), fits).select("page", "id", F.round("x", 4).alias("x"), F.round("w", 6).alias("w"))


# --- sheets ---

BOOK_SQL = """book as (select c_custkey as sheet, [c_custkey || 'a', c_custkey || 'b', c_custkey || 'c'] as r0, [c_custkey || 'd', c_custkey || 'e', c_custkey || 'f'] as r1, c_custkey % 3 as opt from customer)"""


def _book(spark, sf_dir):
    """Every customer is a sheet of three panels and two faces, folded before the second; some are turned or inside out."""
    row = lambda letters: F.array(*(F.concat("c_custkey", F.lit(x)) for x in letters))
    c = _table(spark, sf_dir, "customer")
    opt = F.col("c_custkey") % 3
    return c.select(F.col("c_custkey").alias("sheet"), F.array(row("abc")).alias("inside"), F.array(row("def")).alias("outside"), F.lit(1).alias("spine"), F.lit(0).alias("proper"), F.lit(None).cast("int").alias("new_spine"), (opt == 1).alias("inside_out"), (opt == 2).alias("rot180"))


@query(f"""with {BOOK_SQL}, h as (select sheet, case opt when 1 then r1 when 2 then list_reverse(r0) else r0 end as i, case opt when 1 then r0 when 2 then list_reverse(r1) else r1 end as o, case when opt = 0 then 1 else 2 end as s from book)
select sheet, 0 as side, array_to_string(o[3 - s + 1:3], '|') as panels, o[3 - s + 1] as shown from h union all
select sheet, 1, array_to_string(i[1:s], '|'), case when s > 1 then o[3 - (s - 2)] else i[s] end from h union all
select sheet, 2, array_to_string(i[s + 1:3], '|'), case when 3 - s > 1 then o[3 - (s + 1)] else i[s + 1] end from h union all
select sheet, 3, array_to_string(o[1:3 - s], '|'), o[3 - s] from h""")
def sheet_sides(spark, sf_dir):
    return O.sides_of(O.handled_sheets(_book(spark, sf_dir))).select("sheet", "side", F.array_join("panels", "|").alias("panels"), "shown")


@query(f"with {BOOK_SQL} select sheet, r0[1] as a, r0[2] as b, case when sheet % 2 = 0 then -1 else 1 end as way from book union all select sheet, r1[2], r1[3], case when sheet % 2 = 0 then 1 else -1 end from book union all select sheet, r0[2], r0[3], 1 from book")
def fold_directions(spark, sf_dir):
    """Even sheets fold out between their first two panels; behind those lie the outside's last two."""
    book = _book(spark, sf_dir)
    panel = lambda f, k: F.col(f)[0][k]
    pairs = book.select("sheet", F.explode(F.array(F.struct(panel("inside", 0).alias("a"), panel("inside", 1).alias("b")), F.struct(panel("outside", 1).alias("a"), panel("outside", 2).alias("b")), F.struct(panel("inside", 1).alias("a"), panel("inside", 2).alias("b")))).alias("p")).select("sheet", "p.*")
    folds = book.filter("sheet % 2 = 0").select("sheet", panel("inside", 1).alias("a"), panel("inside", 0).alias("b"), F.lit("out").alias("way"))
    return O.fold_way(pairs, folds, book)


@query(f"with {SHEETS_SQL}, g as (select order_id, gi, quire, type, list(sheet order by pos) as s from sheets where order_id in ('n3', 'b3') group by all), r as (select * from g where order_id = 'b3'), l as (select * from g where order_id = 'n3') select cast(row_number() over (order by r.gi nulls last, l.gi) as int) as row, coalesce(r.quire, l.quire) as quire, l.gi as left_gi, r.gi as right_gi, coalesce(l.type = r.type and l.s = r.s, false) as same from r full join l on r.quire = l.quire")
def orders_compared(spark, sf_dir):
    return O.compare_orders(_sheets(spark, sf_dir), "n3", "b3")


@query(f"""with {SIDES_SQL}, p as (select order_id, a, b from opened where a is not null and b is not null), q as (select order_id, a as name, b as beside from p union all select order_id, b, a from p),
s as (select sides.*, sheet || ':' || face as name from sides where order_id = 'b3'), t as (select s.*, h.beside is not null and h.beside is distinct from t.beside as new from s left join (select * from q where order_id = 'b3') h using (name) left join (select * from q where order_id = 'n3') t using (name))
select cast(side // 2 as int) as leaf, min(quire) as quire, min(sheet) as sheet, max(name) filter (side % 2 = 0) as recto, max(name) filter (side % 2 = 1) as verso, bool_or(new) filter (side % 2 = 0) as new_recto, bool_or(new) filter (side % 2 = 1) as new_verso from t group by side // 2""")
def leaves_of_order(spark, sf_dir):
    return O.leaf_table(_sheets(spark, sf_dir), "b3", "n3").drop("state")


@query(f"with {SHEETS_SQL}, s as (select *, count(*) over (partition by quire) as n from sheets where order_id = 'n3') select sheet, quire as was, quire as now, case when pos = 1 then 'moved' else 'same' end as state from s where n >= 3 union all select sheet || '+', null, quire, 'new' from s where n >= 3 and pos = 2 union all select sheet || '-', quire, null, 'gone' from s where n >= 3 and pos = 3")
def known_moves(spark, sf_dir):
    """In every gathering of three sheets or more the first goes to the end; the others keep their order, which is the longest. One sheet is new, one is gone."""
    one = _sheets(spark, sf_dir).filter("order_id = 'n3'").withColumn("n", F.count("*").over(Window.partitionBy("quire"))).filter("n >= 3").drop("n")
    gone = one.filter("pos = 3").withColumns({"sheet": F.concat("sheet", F.lit("-")), "pos": F.lit(2000)})
    new = one.filter("pos = 2").withColumns({"sheet": F.concat("sheet", F.lit("+")), "pos": F.lit(2000), "order_id": F.lit("m3")})
    other = one.withColumn("order_id", F.lit("m3")).withColumn("pos", F.when(F.col("pos") == 1, 1000).otherwise(F.col("pos")))
    return O.moved(one.unionByName(gone).unionByName(other).unionByName(new), "m3", "n3")


@query("""with v as (select distinct c_nationkey as sheet, c_custkey % 4 as leaf, c_mktsegment as value from customer where c_mktsegment in ('MACHINERY', 'BUILDING') and c_custkey % 5 <> 0) select sheet, leaf, string_agg(value, '|' order by case value when 'MACHINERY' then 0 else 1 end) as "values" from v group by all""")
def overlay_values(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") % 4).alias("leaf"), F.col("c_mktsegment").alias("value"), (F.col("c_custkey") % 5 == 0).alias("missing"))
    return O.overlay(c, ["MACHINERY", "BUILDING"])[0].withColumn("values", F.array_join("values", "|"))


@query("""with v as (select distinct c_nationkey as sheet, c_custkey % 4 as leaf, c_mktsegment as value from customer where c_mktsegment in ('MACHINERY', 'BUILDING') and c_custkey % 5 <> 0) select value, count(*) as leaves from v group by value""")
def overlay_legend(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") % 4).alias("leaf"), F.col("c_mktsegment").alias("value"), (F.col("c_custkey") % 5 == 0).alias("missing"))
    return O.overlay(c, ["MACHINERY", "BUILDING"])[1]


# --- the personal store ---


@query("select cast(row_number() over (order by case when c_custkey % 2 = 0 then -c_custkey end nulls last, c_acctbal, c_custkey) as int) as row, c_custkey as page from customer")
def bookmarks_in_order(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    marks = c.select(F.col("c_custkey").alias("page"), F.struct("c_acctbal", "c_custkey").alias("ord"))
    return U.in_reading_order(marks, c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("page"), (-F.col("c_custkey")).alias("pos"))).select("row", "page")


@query("select p_partkey as id, case when p_partkey % 4 = 0 then 'Search' else left(trim(p_name), 80) end as name, '#text/x/search?q=' || p_partkey as hash from part where p_partkey % 3 <> 0")
def searches_cleaned(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "#read/x/y").otherwise("#text/x/search?q=")
    return U.clean_searches(p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat(kind, "p_partkey").alias("hash")))


@query("with s as (select c_nationkey as id, 'set-' || c_nationkey || '-x' as name, c_custkey // 2 as page, min(c_custkey) as ord from customer where c_custkey // 2 <= (select max(s_suppkey) from supplier) and c_custkey // 2 in (select s_suppkey from supplier) group by all) select id, name, string_agg(cast(page as varchar), ' ' order by ord) as pages from s group by all")
def sets_cleaned(spark, sf_dir):
    """Two customers name one page; pages that are no supplier's don't exist."""
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("id"), F.concat(F.lit(" Set "), "c_nationkey", F.lit(" X!")).alias("name"), F.expr("c_custkey div 2").alias("page"), F.col("c_custkey").alias("ord"))
    return U.clean_sets(rows, _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"))).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), " "))


@query("select s_suppkey as id, '#read/o/' || s_suppkey || '/text?w=1' as hash, 'label' as label, left(trim(s_name), 2000) as note from supplier where s_suppkey % 2 = 0")
def places_cleaned(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "/text?w=1").otherwise("/image?w=1")
    return U.clean_places(s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("#read/o/"), "s_suppkey", kind).alias("hash"), F.lit(" label ").alias("label"), F.concat(F.lit(" "), "s_name").alias("note")))


@query("with k as (select c_custkey, 'o' || c_custkey % 3 as o from customer where c_custkey <= 60 and c_custkey % 2 = 1), every as (select distinct o, n_nationkey as sheet from k, nation) select o as order_id, cast(e.sheet as bigint) as sheet, cast(first as int) as ord, first is null as aside from every e left join (select o, c_custkey % 25 as sheet, min(c_custkey) as first from k group by all) f using (o, sheet)")
def order_cleaned(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").filter("c_custkey <= 60 and c_custkey % 2 = 1")
    rows = c.select(F.concat(F.lit("o"), F.col("c_custkey") % 3).alias("order_id"), (F.col("c_custkey") % 25).cast("long").alias("sheet"), F.lit("q").alias("quire"), F.col("c_custkey").cast("int").alias("ord"))
    known = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sheet"))
    return U.clean_order(rows, known).select("order_id", "sheet", "ord", F.col("quire").isNull().alias("aside"))


@query("select c_custkey as key, coalesce(case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then nullif('', '') else c_name end, case when c_custkey % 2 = 0 then c_mktsegment end) as value from customer")
def store_restored(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    first = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_name")).alias("value"))
    second = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("value"))
    return U.restored(first, second, "key")


@query("select n_name as name, case when n_nationkey < 10 then 'new' else 'old' end as body from nation where n_nationkey < 20 union all select n_name || '+', 'new' from nation where n_nationkey < 3")
def sets_upserted(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.lit("old").alias("body"))
    new = n.filter("n_nationkey < 10").select(F.col("n_name").alias("name"), F.lit("new").alias("body"))
    return U.upsert(old, new.unionByName(n.filter("n_nationkey < 3").select(F.concat("n_name", F.lit("+")).alias("name"), F.lit("new").alias("body"))))
