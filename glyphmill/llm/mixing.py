"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... Each is to fill its share of all words, but no more
than CAP times its own. Clamping and resharing ends at one water level L: every source gets min(cap, L * weight), and
the clamped sources are those with the least cap per weight. So the level comes from running sums over the sources in
that order, one row for each source.

A source with target t and size s is repeated floor(t / s) times whole; of the remaining fraction, documents are taken
in a seeded order until their words reach it, to the nearest document. That order is cut into buckets of about BUCKET
documents whose word totals give each bucket its offset, so no source's rows ever meet in one task.

Defined results: a null text has size 0 and takes 0 words; a source whose documents are all of size 0 has target 0; null
is a source of its own. Repeated rows are ordered by doc_id and size, and each counts as a document. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAP, SEED, BUCKET = 3, 11, 400


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % 3
    ranked = by_source.withColumn("weight", F.when(place == 0, 5).when(place == 1, 2).otherwise(1).cast("long")).withColumn("cap", CAP * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / free).withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
    # the level is that of the first source that isn't clamped at it
    found = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return level.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), found * F.col("weight")), F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, ws: C.Workspace | None = None, joint: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the row's copies, for each row of docs; joint: for each doc_id of a source."""
    ws = ws or C.Workspace(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long")
    slim = docs.select("doc_id", "source", size.alias("size"), F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))).alias("lot"))
    if joint:
        slim = slim.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.first("lot").alias("lot"))
    slim = ws.store(slim, "sizes")
    goal = targets(slim)
    counts = slim.groupBy("source").agg(F.count("*").alias("n"))
    spread = F.floor(F.conv(F.substring("lot", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("n") / BUCKET)).cast("long")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    put = slim.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", spread).drop("s", "n")
    totals = put.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    totals = totals.join(goal.withColumnRenamed("source", "s"), totals.source.eqNullSafe(F.col("s"))).drop("s")
    put, totals = put.alias("p"), totals.alias("t")
    row = put.join(totals, same({"source": F.col("p.source")}, {"source": F.col("t.source")}) & (F.col("p.bucket") == F.col("t.bucket")))
    row = row.select("p.doc_id", "p.source", "p.size", "p.lot", "p.bucket", "t.ahead", "t.source_size", "t.target")
    run = Window.partitionBy("source", "bucket").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("ahead") + F.coalesce(F.sum("size").over(run), F.lit(0))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    more = (2 * reach + F.col("size")).cast("double") <= 2.0 * (F.col("target") - (F.col("times") * F.col("source_size")).cast("double"))
    row = row.withColumn("times", times).withColumn("copies", F.col("times") + F.when((F.col("times") < CAP) & more, 1).otherwise(0))
    return row.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents without words are not taken. All columns stay.

    Rows that repeat a doc_id are planned as one document of their joint size, and taken together.
    """
    ws = C.Workspace(docs.sparkSession)
    own, times = C.free_name(docs, "own_id"), C.free_name(docs, "own_copies")
    picks = ws.store(plan(docs.withColumn("doc_id", C.own_id()), ws, joint=True).filter("taken > 0").select(F.col("doc_id").alias(own), F.col("source").alias("s"), F.col("copies").alias(times)), "picks")
    taken = docs.withColumn(own, C.own_id()).alias("d").join(C.by_size(picks, picks.count()).alias("p"), (F.col(f"d.{own}") == F.col(f"p.{own}")) & F.col("d.source").eqNullSafe(F.col("p.s")))
    return taken.select("d.*", f"p.{times}", F.explode(F.sequence(F.lit(1), F.col(f"p.{times}"))).alias(f"{times}_")).select(docs.columns)


ORACLE = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                  md5(concat('11:', cast(doc_id as varchar))) as lot from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from s),
l as (select *, cap / weight as ratio,
        (sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
      from r window w as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, least(cast(cap as double), (select arg_min(level, ratio) from l where ratio >= level) * weight) as target from l),
c as (select d.*, source_size, target, floor(target / source_size) as times,
        coalesce(sum(size) over (partition by d.source order by lot, doc_id, size rows between unbounded preceding and 1 preceding), 0) as reach
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, cast(target as double) as target,
       cast(size * (times + case when times < 3 and 2 * reach + size <= 2.0 * (target - times * source_size) then 1 else 0 end) as bigint) as taken
from c
"""
