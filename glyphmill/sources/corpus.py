"""The line model over the driver's documents: loci, tokens, page facts, witnesses.

A page is a document, a locus one of its lines. A line is letters of any script with ``.`` for a space and ``,`` for a
comma, which plays the uncertain space. Lines are normalised once for a session and stored as a table partitioned by
ranges of pages (`loci`); readers of some pages touch their ranges only (`lines_of`), and a manifest (`pages_with_data`)
says which pages have lines at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.grouped import slices
from glyphmill.functions.shipping import ship
from glyphmill.sources.cached import table_of

#: What counts as a letter.
LETTERS = r"\pL\pM"
#: The table of lines has about so many rows a range of pages, and at most so many ranges.
RANGE_ROWS, RANGES = 1_000_000, 2000
#: The same lines and page facts in DuckDB, for oracles.
LOCI_SQL = r"""
loci as (
  select page, num, line, kind, num = 0 as ps, cast(page as varchar) || '.' || cast(num as varchar) as locus_id from (
    select doc_id as page, cast(ln - 1 as int) as num, case when contains(t, '|') then 'L' else 'P' end as kind,
           trim(regexp_replace(replace(replace(regexp_replace(lower(t), '[^\pL\pM, ]', '', 'g'), ', ', ','), ' ', '.'), '[.,]*([.,])', '\1', 'g'), '.,') as line
    from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents))),
facts as (
  select doc_id as page, coalesce(source, '–') as scribe, case when quality = 1 then 'good' when quality = 0 then 'poor' else '–' end as section,
         case when toxic = 1 then 'B' when toxic = 0 then 'A' else '–' end as lang, cast(n_chars // 1000 as varchar) as quire
  from documents left join labels using (doc_id))"""
TOKENS_SQL = r"""
words as (select page, num, kind, ps, cast(wi - 1 as int) as wi, s, cast(sum(length(s) + 1) over (partition by page, num order by wi) - length(s) - 1 as bigint) as start, count(*) over (partition by page, num) as n
  from (select page, num, kind, ps, unnest(regexp_split_to_array(line, '[.,]')) as s, generate_subscripts(regexp_split_to_array(line, '[.,]'), 1) as wi from loci where line <> ''))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def normalise(raw):
    """A raw line in the line encoding: of a run of separators the last counts, none stand at the ends."""
    bare = F.regexp_replace(F.lower(raw), f"[^{LETTERS}, ]", "")
    return F.btrim(F.regexp_replace(F.replace(F.replace(bare, F.lit(", "), F.lit(",")), F.lit(" "), F.lit(".")), "[.,]*([.,])", "$1"), F.lit(".,"))


def split_lines(docs: DataFrame) -> DataFrame:
    """page, num, line, kind, ps, locus_id: a row for each line of docs(doc_id, text)."""
    raw = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("num", "raw"))
    kind = F.when(F.contains("raw", F.lit("|")), "L").otherwise("P")
    return raw.select("page", "num", normalise(F.col("raw")).alias("line"), kind.alias("kind"), (F.col("num") == 0).alias("ps"), F.concat_ws(".", "page", "num").alias("locus_id"))


def loci(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """page, num, line, kind, ps, locus_id: a row for each line of the documents, or of those in lang.

    Read from the stored table of lines, which the first use in a session writes to spark.checkpoint.dir; where that is
    not set, lines are made anew. Files that changed since, in folders within folders too, make a table of their own.
    """
    if lang is not None:
        return split_lines(documents(spark, sf_dir).filter(F.col("lang") == lang))
    if not spark.conf.get("spark.checkpoint.dir", None):
        return split_lines(documents(spark, sf_dir))
    return read_lines(spark, table_of(spark, f"{sf_dir}/documents.parquet", "lines", lambda path: store_lines(documents(spark, sf_dir), path)))


_LINES = "page bigint, num int, line string, kind string, ps boolean, locus_id string"


def store_lines(docs: DataFrame, path: str) -> None:
    """Writes the lines of docs as a table partitioned by range, a number that grows with the page."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    lines = split_lines(docs).withColumn("range", F.coalesce(F.floor((F.col("page") - F.lit(low or 0)) / width), F.lit(-1)).cast("int"))
    lines.write.partitionBy("range").option("compression", "zstd").parquet(path)
    # the manifest, from what is stored: pages with lines, and where they are
    stored = docs.sparkSession.read.schema(f"{_LINES}, range int").parquet(path)
    stored.groupBy("page", "range").agg(F.count("*").alias("lines"), F.count_if(F.col("line") != "").alias("written")).write.parquet(f"{path}-pages")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_LINES}, range int").parquet(path).drop("range")


def pages_with_data(spark: SparkSession, path: str) -> DataFrame:
    """The manifest beside a stored table of lines: page, range, lines, and written, how many of them aren't empty."""
    return spark.read.schema("page bigint, range int, lines bigint, written bigint").parquet(f"{path}-pages")


def lines_of(spark: SparkSession, path: str, pages: list[int]) -> DataFrame:
    """The stored lines of some pages; only the ranges that hold them are read, and in those the rows Parquet can't rule out."""
    known = pages_with_data(spark, path).filter(F.col("page").isin(pages)).select("range").distinct()
    ranges = [r["range"] for r in known.collect()]  # RANGES numbers at most
    return spark.read.schema(f"{_LINES}, range int").parquet(path).filter(F.col("range").isin(ranges) & F.col("page").isin(pages)).drop("range")


def page_facts(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """page, scribe, section, lang, quire: what is known of a page, – where nothing is; of all pages, or of those in lang."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    docs = docs if lang is None else docs.filter(F.col("lang") == lang)
    known = docs.select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    section = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("–")
    lang = F.when(F.col("toxic") == 1, "B").when(F.col("toxic") == 0, "A").otherwise("–")
    return known.select(F.col("doc_id").alias("page"), F.coalesce("source", F.lit("–")).alias("scribe"), section.alias("section"), lang.alias("lang"), F.expr("n_chars div 1000").cast("string").alias("quire"))


def words(lines: DataFrame, *keep: str) -> DataFrame:
    """page, num, kind, ps, wi, s, n (and columns to keep): the words of loci, with ordinal and how many the line has."""
    pieces = F.split("line", "[.,]")
    return lines.filter("line <> ''").select("page", "num", "kind", "ps", *keep, F.size(pieces).alias("n"), F.posexplode(pieces).alias("wi", "s"))


def placed_words(lines: DataFrame, *keep: str) -> DataFrame:
    """words plus start, the place in the line. Places are running sums over a slice of lines, linear in its words; a line's words come together, in order."""
    ship(lines.sparkSession)

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (some for whole in batches for some in slices(whole, "line")):
            cut = pc.split_pattern_regex(batch.column("line"), "[.,]")
            row, s = pc.list_parent_indices(cut).to_numpy().astype(np.int64), pc.list_flatten(cut)
            size = np.concatenate([[0], np.cumsum(pc.utf8_length(s).to_numpy(zero_copy_only=False) + 1)])
            n = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
            told = (batch if "line" in keep else batch.drop_columns(["line"])).take(pa.array(row))
            more = {"n": n[row], "wi": np.arange(len(row)) - first[row], "start": size[:-1] - size[first][row]}
            yield pa.RecordBatch.from_arrays([*told.columns, s, *(pa.array(v, pa.int32()) for v in more.values())], [*told.schema.names, "s", *more])

    some = lines.filter("line <> ''").select("page", "num", "kind", "ps", *(c for c in keep if c != "line"), "line")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema if f.name != "line" or "line" in keep)
    return some.mapInArrow(scan, schema + ", s string, n int, wi int, start int")


def tokens(lines: DataFrame, starts: bool = False) -> DataFrame:
    """words plus first, last, and on: whether the next word of the text follows without a break; with starts, start too.

    It does within a line, and from a paragraph line to the next if that one is a paragraph line that starts none. That
    is worked out on lines, before they are cut into words.
    """
    w = Window.partitionBy("page").orderBy("num")
    runs_on = (F.col("kind") == "P") & (F.lead("kind").over(w) == "P") & ~F.lead("ps").over(w)
    heads = lines.filter("line <> ''").withColumn("runs_on", F.coalesce(runs_on, F.lit(False)))
    told = (placed_words if starts else words)(heads, "runs_on")
    last = F.col("wi") == F.col("n") - 1
    return told.select("page", "num", "kind", "ps", "wi", "s", *(["start"] if starts else []), (F.col("wi") == 0).alias("first"), last.alias("last"), (~last | F.col("runs_on")).alias("on"))


#: Rows looked at for each range's bound.
BOUND_ROWS = 50


def numbered_by(rows: DataFrame, name: str, *order, parts: int | None = None) -> DataFrame:
    """rows with name, their number from 1 in the order of the columns and expressions given; nulls come first.

    Rows are dealt to ranges of the order, numbered inside each, and shifted by how many stand in the ranges before; so
    no task holds more than its range. Bounds are taken from the rows of the smallest hashes, so a row's range follows
    from its values alone, however often the plan is run. Rows with equal keys share a range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(2, parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("_key", F.struct(*(c.alias(f"k{k}") for k, c in enumerate(order))))
    some = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(BOUND_ROWS * n).agg(F.array_sort(F.collect_list("_key")).alias("_all"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / n).cast("int")))
    bounds = some.select(F.filter(at, lambda b: b.isNotNull()).alias("_bounds"))
    part = F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))
    dealt = keyed.join(F.broadcast(bounds)).withColumn("_part", part).drop("_bounds")  # one row
    shift = F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = dealt.groupBy("_part").agg(F.count("*").alias("_many")).select(F.col("_part").alias("_of"), shift.alias("_shift"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    joined = dealt.withColumn("_here", here).join(F.broadcast(shifts), F.col("_part") == F.col("_of"))  # a row for each range
    return joined.select(*rows.columns, (F.col("_here") + F.col("_shift")).cast("int").alias(name))


def binding(lines: DataFrame) -> DataFrame:
    """page and pos, its place in the book."""
    return numbered_by(lines.select("page").distinct(), "pos", "page")
