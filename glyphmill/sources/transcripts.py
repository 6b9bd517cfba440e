"""Readers of transcription files and the tables around them.

Line tables (codes, interlinear witnesses, boxes, readings) are read and taken apart with DataFrame functions. The full
transcription format needs a walk in file order (continuations, page tags), so whole files go through Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.shipping import ship

# What a locus line, a page line and a page variable look like; whom the interlinear's letters stand for.
LOCUS = r"^<([^.,>]+)\.(\d+),(.)([A-Z][a-z0-9])(?:;(.))?>\s*(.*)$"
PAGE = r"^<([^.,>]+)>\s*<!([^>]*)>"
VARIABLE = r"\$([A-Z])=(\S)"
VOTER_LETTERS = {"U": "LU", "V": "LV", "T": "LT", "L": "LL", "R": "LR", "X": "LX", "K": "LP", "P": "LP"}


class FormatError(ValueError):
    """A file that breaks the format, in strict mode."""


@dataclass
class Tokens:
    """A locus's text taken apart. uncertain holds (place, alternatives), ligatures (first, after last)."""

    tokens: list[str] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    uncertain: list[tuple[int, list[str]]] = field(default_factory=list)
    ligatures: list[tuple[int, int]] = field(default_factory=list)
    tags: list[tuple[str, str]] = field(default_factory=list)
    para_start: bool = False
    para_end: bool = False


_PIECE = re.compile(r"<(?P<tag>[^>]*)>|(?P<rare>@\d{3};)|\[(?P<alt>[^\]]*)\]|\{(?P<lig>[^}]*)\}|(?P<gap>\?\?\?)|(?P<blank>[ \t]+)|(?P<broken>[<@\[{])|(?P<one>.)", re.DOTALL)


def take_apart(text: str) -> Tokens:
    out = Tokens()
    for m in _PIECE.finditer(text):
        kind = m.lastgroup
        if kind == "broken":
            raise FormatError(f"{m[0]} is broken or never closed in {text!r}")
        if kind == "tag":
            tag = m["tag"]
            if tag in "%$" and tag:
                out.para_start |= tag == "%"
                out.para_end |= tag == "$"
            elif tag in ("-", "~"):
                out.tokens.append("-")
            elif t := re.fullmatch(r"@([A-Z])=(.)", tag):
                out.tags.append((t[1], t[2]))
            else:
                out.comments.append(tag.removeprefix("!"))
        elif kind in ("alt", "lig"):
            at = len(out.tokens)
            inner = m[kind].split(":")[0] if kind == "alt" else m[kind]
            out.tokens += re.findall(r"@\d{3};|[^{}]", inner)
            if kind == "alt":
                out.uncertain.append((at, m["alt"].split(":")))
            else:
                out.ligatures.append((at, len(out.tokens)))
        elif kind != "blank":
            out.tokens.append(m[0])
    return out


def split_words(tokens: list[str]) -> list[tuple[str, str]]:
    """(word, separator after it); of separators in a row the last counts; none before the first word or after the last."""
    out: list[list[str]] = []
    fresh = True
    for t in tokens:
        if t in (".", ",", "-"):
            if out:
                out[-1][1] = t
            fresh = True
        elif fresh:
            out.append([t, ""])
            fresh = False
        else:
            out[-1][0] += t
    if out:
        out[-1][1] = ""
    return [tuple(x) for x in out]


def parse_file(text: str, strict: bool = False) -> tuple[list[dict], list[str]]:
    """The loci of one file in order, with page variables in force, and what was passed over."""
    joined: list[tuple[int, str]] = []
    goes_on = False
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if goes_on and line.startswith("/"):
            joined[-1] = (joined[-1][0], joined[-1][1] + line[1:].rstrip())
        else:
            joined.append((n, line))
        goes_on = joined[-1][1].endswith("/") and joined[-1][1].startswith("<")
        if goes_on:
            joined[-1] = (joined[-1][0], joined[-1][1][:-1])
    out, passed, comments = [], [], []
    page, variables, tags = None, {}, {}
    for n, line in joined:
        if not line.strip() or line.startswith("#="):
            continue
        if line.startswith("#"):
            comments.append(line[1:].strip())
            continue
        if m := re.match(r"^<([^.,>]+)>\s*(?:<!\s*([^>]*)>)?\s*$", line):
            page, variables, tags, comments = m[1], dict(re.findall(VARIABLE, m[2] or "")), {}, []
            continue
        m = re.match(r"^<([^.,>]+)\.(\d+),([@+*=&~/!])([A-Z][a-z0-9])(?:;(.))?>(.*)$", line)
        fault = None
        if not m:
            fault = f"line {n} is no locus: {line!r}"
        elif page is None:
            raise FormatError(f"line {n} is a locus before any page")
        else:
            try:
                t = take_apart(m[6])
            except FormatError as e:
                fault = f"line {n}: {e}"
        if fault:
            if strict:
                raise FormatError(fault)
            passed.append(fault)
            continue
        tags |= dict(t.tags)
        words = split_words(t.tokens)
        out.append({"page": m[1], "num": int(m[2]), "locator": m[3], "type": m[4], "transcriber": m[5], "text": m[6], "words": [w for w, _ in words], "seps": [s for _, s in words], "vars": variables | tags, "comments": t.comments + comments, "para_start": t.para_start, "para_end": t.para_end, "line_no": n})
        comments = []
    return out, passed


LOCI_SCHEMA = "file string, page string, num int, locator string, type string, transcriber string, text string, words array<string>, seps array<string>, vars map<string,string>, comments array<string>, para_start boolean, para_end boolean, line_no int"


def read_transcripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The loci of transcription files, one task a file."""
    ship(spark)

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"file": p, **r} for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in parse_file(bytes(t).decode("latin-1"), strict)[0]]
            names = [c.split()[0] for c in LOCI_SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, LOCI_SCHEMA)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value, with lines numbered inside each file as it stands."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def read_coded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages with variables, and loci keyed by (page, num), the last in the file winning, of a file of coded lines."""
    lines = _lines(spark, path).filter("value not like '#%'")
    pages = lines.filter(F.col("value").rlike(PAGE)).select("file", F.regexp_extract("value", PAGE, 1).alias("page"), variables(F.regexp_extract("value", PAGE, 2)).alias("vars"), "line_no")
    found = lines.filter(F.col("value").rlike(LOCUS)).select("file", "line_no", *(F.regexp_extract("value", LOCUS, k).alias(c) for k, c in enumerate(("page", "num", "loc", "type", "transcriber", "text"), 1)))
    found = found.withColumn("num", F.col("num").cast("int"))
    last = Window.partitionBy("file", "page", "num", "transcriber").orderBy(F.col("line_no").desc())
    return pages, found.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def variables(text: Column) -> Column:
    """A page's $X=v as a map."""
    both = F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(0))
    return F.map_from_entries(F.transform(both, lambda v: F.struct(F.substring(v, 2, 1), F.substring(v, 4, 1))))


def filled_tags(loci: DataFrame) -> DataFrame:
    """loci(page, line_no, tags map) with tags in force: each tag from its line to the end of the page."""
    each = loci.select("page", "line_no", F.explode_outer("tags").alias("k", "v"))
    every = loci.select("page", "line_no").join(each.select("page", "k").distinct().filter("k is not null"), "page")
    told = every.join(each, ["page", "line_no", "k"], "left").withColumn("v", F.last("v", True).over(Window.partitionBy("page", "k").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    maps = told.filter("v is not null").groupBy("page", "line_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("in_force"))
    return loci.join(maps, ["page", "line_no"], "left")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """ord, code, value of a two-column table, without lines that start with # or <."""
    cells = F.split(F.btrim(F.col("value")), r"\s+")
    return _lines(spark, path).filter(~F.col("value").rlike("^[#<]") & (F.size(cells) >= 2)).select(F.col("line_no").alias("ord"), cells[0].alias("code"), cells[1].alias("value"))


def read_interlinear(spark: SparkSession, path: str) -> DataFrame:
    """witness, page, num, text: letters become witnesses; where two letters are one person, K goes before P."""
    _, loci = read_coded(spark, path)
    letter = F.create_map(*(F.lit(x) for kv in VOTER_LETTERS.items() for x in kv))
    told = loci.withColumn("witness", letter[F.col("transcriber")]).filter("witness is not null")
    w = Window.partitionBy("witness", "page", "num").orderBy(F.col("transcriber") == "P", F.col("line_no").desc())
    return told.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("witness", "page", "num", "text")


def cleaned(text: Column) -> Column:
    """A line without comments and markup; drawing breaks become -."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<![^>]*>", ""), r"<[-~]>", "-"), r"<[^>]*>", ""))


def longest_rule(text: Column, rules: dict[str, str], unknown: str | None = "Z1") -> Column:
    """text rewritten by the longest rule at each place; a letter without a rule becomes unknown, or makes all null if that is None."""
    keys = sorted(rules, key=len, reverse=True)
    found = F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*map(re.escape, keys), "."])), F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))
    told = F.transform(found, lambda x: table[x] if unknown is None else F.coalesce(table[x], F.lit(unknown)))
    return F.when(~F.exists(told, lambda x: x.isNull()), F.array_join(told, "")) if unknown is None else F.array_join(told, "")


def to_codes(text: Column, rules: dict[str, str]) -> Column:
    """Letters to codes: comments and ligature braces go, breaks stay, % is skipped text, fillers vanish, the unknown is unreadable."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<![^>]*>|\{[^}]*\}", ""), r"<[-~]>", "-"), r"<[^>]*>", "")
    own = {k: v for k, v in rules.items() if "?" not in v}
    return longest_rule(bare, {**own, ".": ".", ",": ",", "-": "<->", "%": "Z%", "!": "", " ": "", "=": "", "\t": "", "?": "Z1"})


def inverted(used: DataFrame, codes: DataFrame) -> DataFrame:
    """Of codes(code, value) that are written alike, the one used most in used(code): value, code."""
    n = used.groupBy("code").agg(F.count("*").alias("n"))
    told = codes.join(n, "code").filter("value not like '%?%'")
    return told.groupBy("value").agg(F.max_by("code", F.struct(F.col("n"), -F.col("ord"))).alias("code"))


WORD_XML = r'<word\b[^>]*\bindex="(\d+)"[^>]*>([^<]*)</word>'


def read_xml_words(spark: SparkSession, path: str) -> DataFrame:
    """file, index, text of word elements, in order of index."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    each = whole.select("file", F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(WORD_XML), F.lit(1)).alias("i"), F.regexp_extract_all("value", F.lit(WORD_XML), F.lit(2)).alias("t"))).alias("x"))
    return each.select("file", F.col("x.i").cast("int").alias("index"), F.col("x.t").alias("text")).orderBy("file", "index")


READINGS = T.StructType([T.StructField("locus", T.StringType()), T.StructField("word", T.IntegerType()), T.StructField("eva", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("note", T.StringType())])


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings one JSON object a line, as page, readings in order of line and word."""
    page = F.regexp_extract("locus", r"^(.*)\.", 1)
    num = F.substring_index("locus", ".", -1).cast("int")
    rows = spark.read.schema(READINGS).json(path).filter("locus is not null").withColumn("page", page)
    return rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(num.alias("num"), "word", "eva", "confidence", "note"))).alias("readings"))


def read_pages(spark: SparkSession, path: str, schema: T.StructType | str, one_each: bool = True) -> DataFrame:
    """Page files of JSON by a schema that is given, never inferred: one object or list a file, or one object a line."""
    return spark.read.schema(schema).option("multiLine", one_each).json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header in each file; with columns, parts of one export, whose header stands in the first of them only."""
    if columns is None:
        return spark.read.csv(path, header=True)
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).csv(path, header=False, escape='"')
    header = F.array(*columns).eqNullSafe(F.array(*map(F.lit, columns)))
    # one such row is the header; others are data that read the same
    again = rows.filter(header).groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    return rows.filter(~header).unionByName(again.select(*columns, F.explode(F.sequence(F.lit(2).cast("long"), "_n")).alias("_k")).drop("_k"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON at path, or no rows where nothing is there."""
    try:
        out = spark.read.schema(schema).json(path)
        out.limit(0).count()
        return out
    except AnalysisException:
        return spark.createDataFrame([], schema)


def checked(spark: SparkSession, path: str, sums: dict[str, str]) -> DataFrame:
    """Files with their sha256 against what is pinned: file, expected, found, good. A caller refuses on any that isn't good."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("found"))
    want = spark.createDataFrame(list(sums.items()), "file string, expected string")
    return want.join(found, "file", "left").withColumn("good", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def assemble(*sources: tuple[str, DataFrame]) -> DataFrame:
    """witness, page, num, text of several readers' loci as one long table."""
    parts = [d.select(F.lit(w).alias("witness"), "page", "num", "text") for w, d in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def positional(index: DataFrame, lines: DataFrame) -> DataFrame:
    """locus, text, fits: a witness's lines(pos, text) against the index(pos, locus) by place; fits is false where either has no partner."""
    both = index.select("pos", "locus").join(lines.select("pos", "text", F.lit(True).alias("here")), "pos", "full")
    return both.select("pos", "locus", "text", (F.col("locus").isNotNull() & F.coalesce("here", F.lit(False))).alias("fits"))


def by_locus(lines: DataFrame) -> DataFrame:
    """page, num and the witnesses' texts as one map."""
    return lines.groupBy("page", "num").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("witness", "text")))).alias("texts"))


def imported(model: DataFrame, fields: list[str], image: str = "img") -> DataFrame:
    """A model's panels with whitelisted fields only and the image service's address derived from the image's."""
    out = model.select(*(f for f in fields if f in model.columns))
    return out.withColumn("iiif", F.nullif(F.regexp_extract(image, r"^(.*)/full/[^/]*/\d+/[^/]*$", 1), F.lit(""))) if image in out.columns else out


def stale_and_missing(model: DataFrame, here: DataFrame, key: str = "page") -> DataFrame:
    """Keys only in here (stale) or only in model (missing)."""
    stale = here.select(key).distinct().join(model.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    return stale.unionByName(model.select(key).distinct().join(here.select(key), key, "left_anti").withColumn("state", F.lit("missing")))
