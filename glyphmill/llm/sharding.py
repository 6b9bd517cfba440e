"""Shards of near equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id), so equal texts stand together. Probes split each splitter's
interval of keys into equal parts; the exact bytes below each probe are counted over all partitions, and the interval
shrinks to the part that holds the target, until a probe is within tolerance or keys can't be split further. Each round
brings back at most PROBES counts for each splitter. Where one text's copies straddle a target by more than the
tolerance, the splitter goes inside that group, by doc_id. Then every row's shard is known, and one exchange by range
orders the rows; partition totals turn places within partitions into gapless slots.

Law: ``bytes``. Size is the UTF-8 bytes of the text plus 1 (a null text: 1). Shards differ by the tolerance or by one
document, whichever is larger, at each of their two ends. Equal texts share a shard unless their group alone lies
across a splitter.

Defined results: null and empty texts are two groups of their own; rows with a null doc_id come first within their
group; repeated rows take neighbouring slots. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS, PROBES, TOLERANCE = 8, 64, 0.002


def _below(rows: DataFrame, key: str, open_: dict[int, tuple[int, int]], group: int | None) -> dict[int, list[tuple[int, int]]]:
    """For each splitter's interval [low, high) of key, (probe, exact bytes from low to below probe) in order."""
    spans = sorted(set(open_.values()))
    at, low, step = F.lit(None).cast("int"), F.lit(0).cast("long"), F.lit(1).cast("long")
    for i, (a, b) in enumerate(spans):
        inside = (F.col(key) >= a) & (F.col(key) < b)
        wide = max(1, -(-(b - a) // PROBES))
        at, low, step = F.when(inside, i).otherwise(at), F.when(inside, F.lit(a)).otherwise(low), F.when(inside, F.lit(wide)).otherwise(step)
    rows = rows if group is None else rows.filter(F.col("key") == group)
    told = rows.select("size", at.alias("span"), (F.col(key) - low).alias("gap"), step.alias("step"))
    told = told.filter("span is not null").withColumn("part", F.expr("gap div step")).groupBy("span", "part").agg(F.sum("size").alias("bytes"))
    held: dict[int, dict[int, int]] = {}
    for r in told.collect():  # at most PROBES rows for each span
        held.setdefault(r["span"], {})[r["part"]] = r["bytes"]
    out = {}
    for k, (a, b) in open_.items():
        wide, total, found = max(1, -(-(b - a) // PROBES)), 0, []
        parts = held.get(spans.index((a, b)), {})
        for j in range(PROBES):
            if a + j * wide >= b:
                break
            total += parts.get(j, 0)
            found.append((min(b, a + (j + 1) * wide), total))
        out[k] = found
    return out


def _refine(rows, key, goals, low, high, slack, group=None):
    """For each goal (bytes below it wanted) the probe nearest to it, the bytes below it, and the single key that straddles it if any."""
    open_, base, done = {k: (low, high) for k in goals}, dict.fromkeys(goals, 0), {}
    while open_:
        told = _below(rows, key, open_, group)
        for k in list(open_):
            a, b = open_[k]
            before = (a, base[k])
            for probe, more in told[k]:
                now = (probe, base[k] + more)
                if now[1] >= goals[k] or probe >= b:
                    break
                before = now
            best = min(before, now, key=lambda x: abs(x[1] - goals[k]))
            if abs(best[1] - goals[k]) <= slack or now[0] - before[0] <= 1:
                done[k] = (best, before)
                del open_[k]
            else:
                open_[k], base[k] = (before[0], now[0]), before[1]
    return done


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs."""
    spark = docs.sparkSession
    ws = C.Workspace(spark)
    key = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 2)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("at"))
    rows = ws.store(rows, "keys")
    total, largest, least_id, most_id = rows.agg(F.sum("size"), F.max("size"), F.min("at"), F.max("at")).first()
    shard = F.lit(0)
    if total:
        slack = max(TOLERANCE * total / shards, largest / 2)
        found = _refine(rows, "key", {k: total * k / shards for k in range(1, shards)}, 0, 2**62, slack)
        for k, ((probe, below), (last, under)) in sorted(found.items()):
            inside = None
            if abs(below - total * k / shards) > slack:  # copies of one text, key == last, lie across this splitter
                (inside, _), _ = _refine(rows, "at", {0: total * k / shards - under}, least_id, most_id + 1, slack, group=last)[0]
            past = F.col("key") >= probe if inside is None else (F.col("key") > last) | ((F.col("key") == last) & (F.col("at") >= inside))
            shard = shard + past.cast("int")
    rows = rows.withColumn("shard", shard.cast("int"))
    dealt = rows.repartitionByRange("key", "at", "size").sortWithinPartitions("key", "at", "size")
    placed = ws.store(dealt.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))), "placed")
    ends = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("shard", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    ends = ws.store(ends, "offsets")  # at most one row for each partition and one more for each shard
    out = placed.join(C.by_size(ends, ends.count()), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("idx") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
