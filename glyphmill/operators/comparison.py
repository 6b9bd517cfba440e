"""A record of lines against other transcriptions of them: what is alike, what differs, where, and the report of it.

Each line is looked at once, in Arrow batches; all else is aggregation over its facts. What reaches the report is a row
for each measure, section or change, never lines.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.distances import shared_glyphs
from glyphmill.functions.shipping import ship
from glyphmill.operators.consensus import word_edits
from glyphmill.sources import sinks

#: The numbers that mark in-between glyphs, and how many changes a report lists.
IN_BETWEEN, LISTED = "@22", 14
MEASURES = ("words", "differ", "joined_words", "joined_differ", "glyphs", "match")
_FACTS = "missing boolean, words int, same boolean, joined_same boolean, same_glyphs boolean, match int, glyphs int, differ int, joined_words int, joined_differ int"
#: So many pairs of lines of at most so many letters are kept with their facts by a worker, for pairs that come again.
KEPT, SHORT = 1 << 15, 200
_EDITS = "array<struct<kind:string,x:string,y:string,weight:int>>"


def words(line: str | None, commas: bool = True) -> list[str]:
    """The words of a line; uncertain spaces count as spaces, or as none."""
    return [w for w in re.split("[.,]" if commas else r"\.", (line or "") if commas else (line or "").replace(",", "")) if w]


def bare(line: str) -> str:
    """A line's glyphs without spaces, a rare glyph as one."""
    return re.sub("[.,]", "", re.sub(r"@\d{3};", "@", line))


def _facts(c: str | None, o: str | None) -> tuple:
    own = words(c)
    if not o:
        return (True, len(own), *[None] * 8, [])
    other, joined = words(o), words(c, False)
    changed = lambda x, y: sum(len(a) for _, a, _ in word_edits(x, y))
    edits = word_edits(own, other)
    told = [("inbetween" if kind == "glyphs" and IN_BETWEEN in " ".join(y) else kind, " ".join(x), " ".join(y), max(len(x), 1)) for kind, x, y in edits]
    match, glyphs = shared_glyphs(bare(c or ""), bare(o))
    return (False, len(own), own == other, joined == other, bare(c or "") == bare(o), match, glyphs, sum(len(a) for _, a, _ in edits), len(joined), changed(joined, words(o, False)), told)


_kept_facts = lru_cache(KEPT)(_facts)


def facts_of(c: str | None, o: str | None) -> tuple:
    """_facts; those of short lines are kept for pairs that come again."""
    return _kept_facts(c, o) if len(c or "") + len(o or "") <= SHORT else _facts(c, o)


def compared(lines: DataFrame, edits: bool = True) -> DataFrame:
    """lines(name, page, section, locus, c, o) without c and o, with the facts of each: what the record's line c and the transcription's o share.

    A null or empty o is missing. differ counts words of c in changed stretches; joined_ is the same with uncertain
    spaces as none; match and glyphs are glyphs in matching blocks and the longer length, spaces aside; edits lists the
    changes (kind, x, y, weight), where they are asked for.
    """
    ship(lines.sparkSession)
    kept = ("name", "page", "section", "locus")

    def scan(batches):
        import pyarrow as pa

        kinds = [pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int32()] * 5]
        edit = pa.list_(pa.struct([("kind", pa.string()), ("x", pa.string()), ("y", pa.string()), ("weight", pa.int32())]))
        names = [f.split()[0] for f in _FACTS.split(", ")]
        for b in batches:
            rows = [facts_of(c, o) for c, o in zip(b.column("c").to_pylist(), b.column("o").to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 11
            if edits:
                told = pa.array([[dict(zip(("kind", "x", "y", "weight"), e, strict=True)) for e in es] for es in cols[10]], edit)
            more = [told] if edits else []
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=False)), *more], [*kept, *names, *(["edits"] if edits else [])])

    head = ", ".join(f"{n} {lines.schema[n].dataType.simpleString()}" for n in kept)
    return lines.select(*kept, "c", "o").mapInArrow(scan, f"{head}, {_FACTS}" + (f", edits {_EDITS}" if edits else ""))


def totals(facts: DataFrame, *by: str) -> DataFrame:
    """Counts for each of by: loci there and missing, lines alike in three ways, words and glyphs compared, differing and matching."""
    here, count = ~F.col("missing"), lambda c: F.count_if(F.col(c)).alias(c)
    sums = [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).alias(c) for c in MEASURES]
    return facts.groupBy(*by).agg(
        F.count_if(here).alias("loci"), F.count_if("missing").alias("loci_missing"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("words"))), F.lit(0)).alias("missing_words"),
        count("same"), count("joined_same"), count("same_glyphs"), *sums,
    )


def kinds(facts: DataFrame) -> DataFrame:
    """name, kind, n: words of the record in changes of each kind."""
    return facts.select("name", F.explode("edits").alias("e")).groupBy("name", "e.kind").agg(F.sum("e.weight").alias("n"))


def substitutions(facts: DataFrame, listed: int = LISTED) -> DataFrame:
    """name, row, reads, record, n: each transcription's commonest changes of one word for one; listed is the feature."""
    one = facts.select("name", F.explode("edits").alias("e")).filter("e.kind = 'glyphs' and not contains(e.x, ' ') and not contains(e.y, ' ')")
    n = one.groupBy("name", F.col("e.y").alias("reads"), F.col("e.x").alias("record")).agg(F.count("*").alias("n"))
    row = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "reads", "record"))
    return n.withColumn("row", row).filter(F.col("row") <= listed)


def percent(part: Column, whole: Column) -> Column:
    """A share to a tenth of a percent, halves up, in whole numbers; - of nothing."""
    tenths = ((2000 * part.cast("long") + whole.cast("long")) / (2 * whole.cast("long"))).cast("long")
    return F.when(whole > 0, F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))).otherwise("-")


#: The rows of the report's first table: label, and the share or count shown.
ROWS = (
    ("loci it lacks", "loci_missing", None),
    ("lines identical", "same", "loci"),
    ("words that differ", "differ", "words"),
    ("… if uncertain spaces are no space", "joined_differ", "joined_words"),
    ("lines with the same glyphs, spaces aside", "same_glyphs", "loci"),
    ("glyphs that match, spaces aside", "match", "glyphs"),
)


def comparison_report(facts: DataFrame, names: list[str], title: str) -> DataFrame:
    """row, value: the lines of the report: all transcriptions by measure, then for each its kinds of change, commonest changes and sections."""
    all_ = totals(facts, "name")
    cell = lambda part, whole: F.col(part).cast("string") if whole is None else percent(F.col(part), F.col(whole))
    told = all_.select("name", F.posexplode(F.array(*(F.struct(F.lit(label).alias("measure"), cell(p, w).alias("v")) for label, p, w in ROWS))).alias("k", "m"))
    table = told.groupBy((F.col("k") + 1).alias("row"), F.col("m.measure").alias("measure")).pivot("name", names).agg(F.first("m.v"))
    sections = [("Against every transcription", table, ["measure", *names])]
    changes, pairs, by = kinds(facts), substitutions(facts), totals(facts, "name", "section").filter("words > 0")
    for name in names:
        of = lambda d, *order: d.filter(F.col("name") == name).withColumn("row", F.row_number().over(Window.partitionBy("name").orderBy(*order)))  # noqa: B023, E731
        sections += [
            (f"{name}: kinds of difference", of(changes, F.desc("n"), "kind"), ["kind", "n"]),
            (f"{name}: commonest changes", of(pairs.drop("row"), F.desc("n"), "reads", "record"), ["reads", "record", "n"]),
            (f"{name}: by section", of(by.withColumn("share", percent(F.col("differ"), F.col("words"))), F.desc("words"), "section"), ["section", "words", "differ", "share"]),
        ]
    return sinks.report(facts.sparkSession, title, sections)
