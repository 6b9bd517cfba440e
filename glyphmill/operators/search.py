"""Pattern search: hits with offsets, filters, facets, ranges over witnesses, histograms, concordances.

Filters on pages and lines go below the match; only ``at:``, which looks at the hit, stays above. Two ways to find
offsets give equal rows: ``marked`` splits the line at markers set by one regexp_replace and stays in the JVM; it is
the default. ``finditer`` is an Arrow batch function for patterns whose Java and Python readings are alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.distances import near_cost
from glyphmill.functions.grouped import slices
from glyphmill.functions.shipping import ship
from glyphmill.plans.language import KINDS, Query, QueryError, Reading, compile_query, family, near_pattern, parse
from glyphmill.sources.corpus import numbered_by


def _marked(line: Column, pattern: str) -> Column:
    """(start, match) of the leftmost matches that don't overlap and aren't empty."""
    cut = F.split(F.regexp_replace(line, pattern, "\x01$0\x02"), "[\x01\x02]", -1)
    walk = F.aggregate(
        F.transform(cut, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("hits")),
        lambda a, p: F.struct((a["at"] + F.length(p["x"])).alias("at"), F.when((p["i"] % 2 == 1) & (F.length(p["x"]) > 0), F.concat(a["hits"], F.array(F.struct(a["at"].alias("start"), p["x"].alias("match"))))).otherwise(a["hits"]).alias("hits")),
    )
    return walk["hits"]


def matches(lines: DataFrame, pattern: str) -> DataFrame:
    """lines with a row for each match: start, len, match."""
    found = lines.filter(F.col("line").rlike(pattern)).withColumn("h", F.explode(_marked(F.col("line"), pattern)))
    return found.withColumn("start", F.col("h.start")).withColumn("match", F.col("h.match")).withColumn("len", F.length("match")).drop("h")


def matches_python(lines: DataFrame, pattern: str) -> DataFrame:
    """The same by an Arrow batch function; pattern is in Python's dialect."""

    ship(lines.sparkSession)

    def scan(batches):
        import pyarrow as pa

        compiled = re.compile(pattern)
        for batch in batches:
            rows, starts, found = [], [], []
            for i, line in enumerate(batch.column("line").to_pylist()):
                at = 0
                while line and (m := compiled.search(line, at)):
                    if m.end() > m.start():
                        rows.append(i)
                        starts.append(m.start())
                        found.append(m[0])
                        at = m.end()
                    else:
                        at = m.end() + 1
                        if at > len(line):
                            break
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(starts, pa.int32()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int32())], [*out.schema.names, "start", "match", "len"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", start int, match string, len int"
    return lines.mapInArrow(scan, schema)


class SearchTooLong(QueryError):
    """A pattern that runs away on some line."""


def matches_within(lines: DataFrame, pattern: str, seconds: float) -> DataFrame:
    """The same rows, by a matcher that gives up: SearchTooLong in a task whose walk over one line takes so many seconds.

    A Java matcher hears neither a job's cancellation nor an interrupt, so a pattern that backtracks without end would
    hold its executor's core; this one looks at the clock itself. pattern is in Python's dialect.
    """
    from glyphmill.functions.shipping import ship

    ship(lines.sparkSession)

    def scan(batches):
        import pyarrow as pa
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            rows, starts, found = [], [], []
            for i, line in enumerate(batch.column("line").to_pylist()):
                try:
                    hits = [m for m in compiled.finditer(line or "", timeout=seconds) if m.end() > m.start()]
                except TimeoutError:
                    raise SearchTooLong(f"This search took more than {seconds:g} seconds on one line; a simpler pattern, or fewer stars, will be quicker") from None
                rows += [i] * len(hits)
                starts += [m.start() for m in hits]
                found += [m[0] for m in hits]
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(starts, pa.int32()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int32())], [*out.schema.names, "start", "match", "len"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", start int, match string, len int"
    return lines.mapInArrow(scan, schema)


def counts(lines: DataFrame, pattern: str) -> DataFrame:
    """page and its number of matches, without offsets."""
    return lines.groupBy("page").agg(F.sum(F.regexp_count("line", F.lit(pattern))).alias("n")).filter("n > 0")


def near_words(lines: DataFrame, word: str, near: int) -> DataFrame:
    """w and cost: the words of lines within near edits of word, where an edit inside a family costs half.

    Words are cut at certain spaces only and compared without uncertain ones. Only different words of a fitting length
    leave a slice of lines, so that edits are counted for spellings, not for every place.
    """
    ship(lines.sparkSession)
    low, high = len(word) - near, len(word) + near

    def fitting(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for some in slices(batch, "line"):
                w = pc.unique(pc.list_flatten(pc.split_pattern(some.column("line"), ".")))
                size = pc.utf8_length(pc.replace_substring(w, ",", ""))
                fit = pc.and_(pc.not_equal(w, ""), pc.and_(pc.greater_equal(size, low), pc.less_equal(size, high)))
                yield pa.RecordBatch.from_arrays([w.filter(fit)], ["w"])

    close = lines.select("line").mapInArrow(fitting, "w string").distinct()
    bare = F.replace("w", F.lit(","), F.lit(""))
    # an edit costs half at most once for each letter with a family, so plain edits rule out most spellings at little cost
    edits = near + sum(bool(set(family(c) or "") - {c}) for c in word) // 2
    some = close.filter(F.levenshtein(bare, F.lit(word), edits) >= 0)
    return some.select("w", near_cost(bare, word).alias("cost")).filter(F.col("cost") <= near)


def search(lines: DataFrame, query: str | Query, reading: Reading = Reading(), facts: DataFrame | None = None, order: DataFrame | None = None, sets: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """The hits of query on lines(page, num, line, kind, ps), with start, len and match.

    facts(page, scribe, section, lang, quire), order(page, pos) and sets(name, page) are what filters look into. With
    seconds, a walk over one line that takes longer ends in SearchTooLong.
    """
    query = parse(query) if isinstance(query, str) else query
    first, last = [f for f in query.filters if f[0] != "at"], [f for f in query.filters if f[0] == "at"]
    lines = narrowed(lines, first, facts, order, sets)
    word = query.items[0].literal if len(query.items) == 1 and hasattr(query.items[0], "literal") else None
    if reading.near and word:
        near = [r["w"] for r in near_words(lines, word, reading.near).orderBy("cost", "w").collect()]  # distinct spellings within two edits of a word
        # a part that is near by itself is the hit, not the spelling with an uncertain space around it
        near = [w for w in near if "," not in w or not {*w.split(",")} & {*near}]
        pattern = near_pattern(near, word)
    else:
        pattern = compile_query(query, reading, "java" if seconds is None else "python")
    if pattern is None:
        return lines.filter(F.lit(False)).select("*", F.lit(0).alias("start"), F.lit("").alias("match"), F.lit(0).alias("len"))
    hits = matches(lines, pattern) if seconds is None else matches_within(lines, pattern, seconds)
    for _, value in last:
        hits = hits.filter(at_place(value))
    return hits


def at_place(value: str) -> Column:
    """at:para is the start of a paragraph, even if the value also says end; at:..end.. a line's end; else its start."""
    if value.startswith("para"):
        return F.col("ps") & (F.col("start") == 0)
    if "end" in value:
        return F.col("start") + F.col("len") == F.length("line")
    return F.col("start") == 0


def narrowed(lines: DataFrame, filters: list[tuple[str, str]], facts=None, order=None, sets=None) -> DataFrame:
    """lines on pages, and of kinds, that pass every filter."""
    for key, value in filters:
        if key == "in":
            lines = lines.filter(F.col("kind") == KINDS.get(value, value[:1].upper()))
        elif key == "page":
            lines = _on_pages(lines, value, order)
        elif key == "set":
            named = sets.filter(F.col("name") == value).select("page").distinct() if sets is not None else lines.select("page").filter(F.lit(False))
            lines = lines.join(named, "page", "left_semi")
        else:
            lines = lines.join(facts.filter(_fact(key, value)).select("page"), "page", "left_semi")
    return lines


def _fact(key: str, value: str) -> Column:
    if key == "scribe":
        return F.col("scribe") == value
    if key == "lang":
        return F.lower("lang") == value
    if key == "section":
        return F.contains(F.lower("section"), F.lit(value))
    low, _, high = value.partition("-")
    try:
        low, high = float(low), float(high or low)
    except ValueError:
        return F.lit(False)
    return F.expr("try_cast(quire as double)").between(low, high or low)


def _on_pages(lines: DataFrame, value: str, order: DataFrame | None) -> DataFrame:
    """page:x is x and its panels, x with one digit; page:a-b what stands between in the binding; more ends name no pages."""
    ends = [e.removeprefix("f") for e in value.split("-")]
    short = lambda c: F.regexp_replace(c.cast("string"), "^f", "")
    if len(ends) == 1:
        return lines.filter((short(F.col("page")) == ends[0]) | short(F.col("page")).rlike(f"^{re.escape(ends[0])}\\d$"))
    if len(ends) > 2:
        return lines.filter(F.lit(False))
    bounds = order.filter(short(F.col("page")).isin(ends)).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_distinct("page").alias("known"))
    inside = (F.col("known") == len(set(ends))) & F.col("pos").between(F.col("low"), F.col("high"))
    return lines.join(order.join(F.broadcast(bounds), inside, "left_semi").select("page"), "page", "left_semi")  # one row


def with_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """hits with their page's facts, – where the page has none."""
    out = hits.join(facts, "page", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("–")) for c in ("scribe", "section", "lang", "quire")})


def summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits"), F.count_distinct("page", "num").alias("lines"), F.count_distinct("page").alias("pages"))


FACETS = ("scribe", "section", "lang", "kind", "quire")


def facets(told: DataFrame) -> DataFrame:
    """facet, value, hits over hits with facts, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FACETS)))
    return told.select(each.alias("f")).select("f.facet", "f.value").groupBy("facet", "value").agg(F.count("*").alias("hits"))


def ranked_facets(told: DataFrame, order: DataFrame) -> DataFrame:
    """facets with their row: sections by place in the book, quires by number (others last), the rest by count."""
    counted = facets(told.join(order, "page", "left").withColumn("pos", F.coalesce("pos", F.lit(10**6))))
    first = told.join(order, "page", "left").groupBy(F.lit("section").alias("facet"), F.col("section").alias("value")).agg(F.min("pos").alias("pos"))
    key = F.when(F.col("facet") == "section", F.col("pos").cast("double")).when(F.col("facet") == "quire", F.coalesce(F.expr("try_cast(value as double)"), F.lit(99.0))).otherwise(-F.col("hits").cast("double"))
    w = Window.partitionBy("facet").orderBy("key", "value")
    return counted.join(first, ["facet", "value"], "left").withColumn("key", key).select("facet", "value", "hits", F.row_number().over(w).alias("row"))


def narrow_steps(told: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for key, value in steps:
        told = told.filter(F.col(key) == value)
    return told


def witness_range(hits: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Lowest and highest count over witnesses(witness); one without a hit counts 0. hits has a column witness."""
    n = hits.groupBy("witness").agg(F.count("*").alias("n"))
    each = witnesses.select("witness").distinct().join(n, "witness", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.agg(F.min("n").alias("low"), F.max("n").alias("high")).withColumn("said", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("–", "low", "high")))


def any_witness(hits: DataFrame) -> DataFrame:
    """Hits of several witnesses as one where the same text occurs the n-th time on the same line; who lists them."""
    bare = hits.withColumn("bare", F.replace("match", F.lit(","), F.lit("")))
    nth = F.row_number().over(Window.partitionBy("witness", "page", "num", "bare").orderBy("start"))
    return bare.withColumn("nth", nth).groupBy("page", "num", "bare", "nth").agg(F.array_join(F.array_sort(F.collect_set("witness")), " ").alias("who"), F.min("start").alias("start"))


def histogram(hits: DataFrame, order: DataFrame, narrowed_hits: DataFrame | None = None) -> DataFrame:
    """pos, all and now: hits on every page in order, zero where there are none; now counts the narrowed ones."""
    each = hits.groupBy("page").agg(F.count("*").alias("all"))
    now = (narrowed_hits if narrowed_hits is not None else hits).groupBy("page").agg(F.count("*").alias("now"))
    return order.join(each, "page", "left").join(now, "page", "left").select("page", "pos", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("now", F.lit(0)).alias("now"))


def before(hits: DataFrame) -> Column:
    return F.substring("line", F.lit(1), F.col("start"))


def after(hits: DataFrame) -> Column:
    return F.substring("line", F.col("start") + F.col("len") + 1, F.length("line"))


def concordance(hits: DataFrame, by: str = "book", order: DataFrame | None = None) -> DataFrame:
    """hits with their number in the order asked: book, right, left or match."""
    here = ["page", "num", "start"]
    told = hits.join(order, "page", "left").withColumn("pos", F.coalesce("pos", F.lit(10**6))) if order is not None else hits.withColumn("pos", F.col("page"))
    right, left = F.regexp_replace(after(hits), "^[.,]", ""), F.reverse(F.regexp_replace(before(hits), "[.,]$", ""))
    keys = {"book": [], "right": [right == "", right], "left": [left == "", left], "match": [F.col("match")]}[by]
    told = told.withColumn("right", right).withColumn("left", left)
    return numbered_by(told, "row", *keys, "pos", *here)


def first_rows(hits: DataFrame, size: int = 150) -> DataFrame:
    """In book order the first size hits, numbered, and the rest of the line that the last of them is on. A top-k, no full sort."""
    here = ["page", "num", "start"]
    top = hits.orderBy(*here).limit(size)
    last = top.orderBy(*(F.desc(c) for c in here)).limit(1).select(F.col("page").alias("p"), F.col("num").alias("n"), F.col("start").alias("s"))
    rest = hits.join(F.broadcast(last), (F.col("page") == F.col("p")) & (F.col("num") == F.col("n")) & (F.col("start") > F.col("s")), "left_semi")  # one row
    return top.unionByName(rest).withColumn("row", F.row_number().over(Window.orderBy(*here)))


def clipped(text: Column, size: int, end: str) -> Column:
    """Context cut to size characters with an ellipsis: end right keeps the last ones, left the first."""
    cut = F.concat(F.lit("…"), F.right(text, F.lit(size))) if end == "right" else F.concat(F.left(text, F.lit(size)), F.lit("…"))
    return F.when(F.length(text) > size, cut).otherwise(text)


def segments(line: Column, cuts: Column) -> Column:
    """(text, marked) pieces of a line for cuts(start, len) in order; a cut inside an earlier one is clipped or left out."""
    cell = "array<struct<text:string,marked:boolean>>"
    walk = F.aggregate(
        F.array_sort(cuts),
        F.struct(F.lit(0).alias("at"), F.array().cast(cell).alias("all")),
        lambda a, c: F.when(c["start"] + c["len"] <= a["at"], a).otherwise(
            F.struct(
                (c["start"] + c["len"]).alias("at"),
                F.concat(
                    a["all"],
                    F.when(c["start"] > a["at"], F.array(F.struct(F.substring(line, a["at"] + 1, c["start"] - a["at"]).alias("text"), F.lit(False).alias("marked")))).otherwise(F.array().cast(cell)),
                    F.array(F.struct(F.substring(line, F.greatest(a["at"], c["start"]) + 1, c["start"] + c["len"] - F.greatest(a["at"], c["start"])).alias("text"), F.lit(True).alias("marked"))),
                ).alias("all"),
            )
        ),
        lambda a: F.when(a["at"] < F.length(line), F.concat(a["all"], F.array(F.struct(F.substring(line, a["at"] + 1, F.length(line)).alias("text"), F.lit(False).alias("marked"))))).otherwise(a["all"]),
    )
    return walk
