"""Exports: hits and places as CSV, lines as transcription files, locus lists, partitioned JSON, reports."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.sources.corpus import numbered_by


def locus_list(ranked: DataFrame) -> DataFrame:
    """Every locus with a hit once, numbered in the order of its first hit."""
    first = ranked.groupBy("page", "num").agg(F.min("row").alias("at"))
    return numbered_by(first, "row", "at").select(F.concat_ws(".", "page", "num").alias("locus_id"), "row")


def quoted(value: Column, always: bool = False) -> Column:
    """A CSV cell: quotes doubled; quoted if it needs to be, or always."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    full = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return full if always else F.when(text.rlike('[",\n]'), full).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str], always: bool = False) -> DataFrame:
    """rows (ordered by column row) as value lines; the caller writes the header."""
    return rows.select("row", F.concat_ws(",", *(quoted(F.col(c), always) for c in columns)).alias("value"))


def write_csv(rows: DataFrame, columns: list[str], path: str, always: bool = False) -> None:
    """A CSV of rows in their order: a header, then the lines; files follow the order of their names."""
    rows.sparkSession.createDataFrame([(0, ",".join(columns))], "row int, value string").unionByName(csv_lines(rows, columns, always)).repartitionByRange("row").sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)


def transcription(lines: DataFrame) -> DataFrame:
    """row and value of a transcription file for lines(page, num, line, kind, ps, pe, loc): a page header where the page changes."""
    new = F.row_number().over(Window.partitionBy("page").orderBy("num")) == 1
    told = numbered_by(lines, "n", "page", "num").withColumn("new", new)
    head = F.concat(F.lit("<f"), F.col("page").cast("string"), F.lit(">"))
    name = F.concat(F.lit("<f"), F.col("page").cast("string"), F.lit("."), F.col("num").cast("string"), F.lit(","), F.col("loc"), F.col("kind"), F.lit("0>"))
    padded = F.when(F.length(name) < 19, F.rpad(name, 19, " ")).otherwise(name)
    text = F.concat(padded, F.when(F.col("ps"), "<%>").otherwise(""), F.col("line"), F.when(F.col("pe"), "<$>").otherwise(""))
    each = told.select(F.explode(F.when(F.col("new"), F.array(F.struct((F.col("n") * 2).alias("row"), head.alias("value")), F.struct((F.col("n") * 2 + 1).alias("row"), text.alias("value")))).otherwise(F.array(F.struct((F.col("n") * 2 + 1).alias("row"), text.alias("value"))))).alias("x"))
    return each.select("x.row", "x.value")


def write_pages(records: DataFrame, path: str) -> None:
    """One folder of JSON for each page."""
    records.repartition("page").write.mode("overwrite").partitionBy("page").json(path)


def write_witnesses(lines: DataFrame, path: str) -> None:
    lines.repartition("witness").write.mode("overwrite").partitionBy("witness").parquet(path)


def store_export(store: DataFrame, fields: list[str]) -> DataFrame:
    """The personal store's whitelisted fields as one JSON document."""
    return store.select(F.to_json(F.struct(*(F.col(f) for f in fields if f in store.columns))).alias("value"))


def file_name(query: str, suffix: str = "csv", today: date | None = None) -> str:
    """A file name from a query: runs of other characters become one hyphen."""
    slug = re.sub(r"[^a-z0-9]+", "-", query.lower()).strip("-")[:40]
    return f"search-{slug or 'all'}-{(today or date.today()).isoformat()}.{suffix}"


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a small result."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"


def report(spark, title: str, sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """row and value: the lines of a Markdown report, a heading and a table for each (heading, frame, columns); frames are ordered by column row."""
    fixed, parts = [(0, 0, f"# {title}"), (0, 1, "")], []
    for k, (heading, frame, columns) in enumerate(sections, 1):
        fixed += [(k, 0, f"## {heading}"), (k, 1, ""), (k, 2, "| " + " | ".join(columns) + " |"), (k, 3, "|" + " --- |" * len(columns))]
        cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), " | "), F.lit(" |"))
        parts.append(frame.select(F.lit(k).alias("part"), (F.col("row") + 3).cast("long").alias("place"), cells.alias("value")))
    lines = spark.createDataFrame(fixed, "part int, place long, value string")
    for p in parts:
        lines = lines.unionByName(p)
    return numbered_by(lines, "row", "part", "place").select("row", "value")


def hit_rows(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """The twelve columns of exported hits, numbered in book order: scribes are joined by blanks, contexts stand beside the match."""
    told = hits.join(facts, "page", "left")
    scribe = F.array_join("scribe", " ") if dict(facts.dtypes)["scribe"].startswith("array") else F.col("scribe")
    cut = {"locus": F.concat_ws(".", "page", "num"), "page": F.col("page"), "line": F.col("num"), "kind": F.col("kind"), "before": F.substring("line", F.lit(1), F.col("start")), "match": F.col("match"), "after": F.substring("line", F.col("start") + F.col("len") + 1, F.length("line")), "text": F.col("line"), "scribe": scribe, "section": F.col("section"), "language": F.col("lang"), "quire": F.col("quire")}
    return numbered_by(told, "row", "page", "num", "start").select("row", *(c.alias(n) for n, c in cut.items()))
