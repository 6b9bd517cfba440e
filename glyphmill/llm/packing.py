"""Best-fit packing under conflicts.

Documents become pieces of at most CAPACITY words: whole CAPACITY-word pieces fill a bin each, the rest are packed. The
pieces are dealt by a hash of doc_id to groups of about GROUP pieces, so no source or cluster meets in one task. Within
a group, pieces are taken largest first. Open bins stand ordered by residual; each carries two bitmaps of sources (one
piece seen, two pieces seen) and one of duplicate clusters. From the successor of the piece's size on, bins are tried
until one is compatible: no piece of the same cluster, and fewer than two pieces of the same source. That bin is the
tightest that will do; if there is none, a bin opens.

A cluster is the set of equal texts, unless the input has a column ``cluster``.

Defined results: null, empty and white-space texts have no words and no piece: one row with null bin and size 0. A null
source is a source of its own. A null doc_id is dealt by its text. Repeated rows are copies of one text, so they never
share a bin. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY, GROUP = 4096, 4096
SCHEMA = "doc_id long, source string, piece int, first_word long, n_words long, bin string, offset int"


def best_fit(sizes, sources, clusters, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sources and clusters are small integers."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    once, twice, seen, left = [], [], [], []
    open_: list[tuple[int, int]] = []  # (residual, bin) in order
    out = [(0, 0)] * len(sizes)
    for i in order:
        size, s, c = sizes[i], 1 << sources[i], 1 << clusters[i]
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (twice[b := open_[at][1]] & s or seen[b] & c):
            at += 1
        if at < len(open_):
            b = open_.pop(at)[1]
        else:
            b = len(left)
            once.append(0)
            twice.append(0)
            seen.append(0)
            left.append(capacity)
        out[i] = (b, capacity - left[b])
        twice[b] |= once[b] & s
        once[b] |= s
        seen[b] |= c
        left[b] -= size
        if left[b]:
            insort(open_, (left[b], b))
    return out


def _pack(pdf):
    """Packs one group; the rows of a group have the same value in column deal."""
    pdf = pdf.sort_values(["lot", "row", "piece"]).reset_index(drop=True)
    sources = pdf["source"].astype(object).where(pdf["source"].notna(), None)
    codes = {s: k for k, s in enumerate(sorted({s for s in sources if s is not None}))}
    src = [codes[s] if s is not None else len(codes) for s in sources]
    ids: dict = {}
    clu = [ids.setdefault(c, len(ids)) for c in pdf["cluster"]]
    got = best_fit(pdf["n_words"].astype(int).tolist(), src, clu)
    deal = int(pdf["deal"].iloc[0])
    out = pdf[["doc_id", "source", "piece", "first_word", "n_words"]].copy()
    out["bin"] = [f"{deal}-{b}" for b, _ in got]
    out["offset"] = [o for _, o in got]
    return out


def pack(docs: DataFrame) -> DataFrame:
    """A row for each piece of each row of docs: SCHEMA."""
    ws = C.Workspace(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long")
    own = F.col("cluster").cast("string") if "cluster" in docs.columns else F.hex(F.xxhash64("text"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), size.alias("size"), own.alias("cluster"), F.xxhash64("doc_id", "text").alias("lot"), F.monotonically_increasing_id().alias("row"))
    slim = ws.store(slim, "sizes")
    count = slim.agg(F.count("*").alias("n")).first()["n"]
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CAPACITY).cast("int")))
    pieces = slim.filter("size > 0").withColumn("piece", piece)
    pieces = pieces.withColumn("first_word", (F.col("piece") * CAPACITY).cast("long")).withColumn("n_words", F.least(F.col("size") - F.col("first_word"), F.lit(CAPACITY)))
    name = ["doc_id", "source", "piece", "first_word", "n_words"]
    # equal rows are told apart by number, so that reruns name bins alike
    copy = F.row_number().over(Window.partitionBy("doc_id", "lot", "piece").orderBy("row"))
    full = pieces.filter(F.col("n_words") == CAPACITY).withColumn("copy", copy).select(*name, F.concat_ws("-", F.lit("full"), "doc_id", F.hex("lot"), "copy", "piece").alias("bin"), F.lit(0).alias("offset"))
    deal = F.pmod(F.xxhash64("lot"), F.lit(-(-max(count, 1) // GROUP))).cast("int")
    packed = pieces.filter(F.col("n_words") < CAPACITY).withColumn("deal", deal).groupBy("deal").applyInPandas(_pack, SCHEMA)
    none = slim.filter("size = 0").select("doc_id", "source", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("offset"))
    return packed.unionByName(full).unionByName(none)
