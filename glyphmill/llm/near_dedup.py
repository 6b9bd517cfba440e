"""Near-duplicate documents by SetSketch registers: band register values, estimate jointly, then verify on full sets.

Each document's set of word shingles becomes REGISTERS registers. Register i is floor(1 - log_BASE(e_i)), cut to
0..TOP, where e_i is the least of exponential(RATE) variables, one for each shingle, drawn from its hash. Two sets'
registers agree about as often as their shingles do. BAND registers in a row make a key; documents that share a key
are candidates. With 48 keys of 5 registers, a pair at similarity 0.75 shares none with probability 2.3e-6, and its
estimate is too low with at most 1e-7; it is missed with probability 2.4e-6 in all.

How links are found without listing the pairs of a group:

1. Documents with equal sets (a 128-bit digest of the whole sorted set) are one class; its smallest doc_id stands for it.
2. The groups of the first FIRST_BANDS keys are dealt at random into blocks. In a block the registers tell which pairs
   may reach the threshold; the members of such pairs get their full sets, and the block returns a spanning forest of
   the links that the sets confirm. That joins most copies.
3. Groups of any key that still span several components are cut into blocks again, and every block of members outside
   the group's largest component meets all other blocks. Pairs inside one component aren't looked at, and a pair that
   shares several keys only under the first. Again a block returns a spanning forest.

So no step emits pairs: a block returns fewer rows than it has members. Nothing is capped: step 3 covers every pair that
shares a key and is not yet connected. Its work grows with the members that a group's largest component leaves out.

Shingles are 64-bit hashes of their words; a pair's counts are wrong only if two of its own shingles collide.

Defined results: a text that is null, empty or white space has no shingles, links with nothing and is its own
component. A text of fewer words than a shingle has one shingle, all its words. Repeated rows give repeated rows, each
the same. Rows with a null doc_id come back with null component_id and kept false, and link with nothing. Extra columns
of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REGISTERS, BAND = 240, 5
BASE, RATE, TOP = 1.02, 20.0, 1500
#: A pair is checked if the likelihood puts its similarity at this or more; at 0.75 it falls below with probability 1e-7.
ESTIMATE = 0.6
#: The first round looks at the groups of so many keys; it connects most copies, so that the second compares few pairs.
FIRST_BANDS = 6
#: A block has about so many members, and so many shingles unless one member has more.
BLOCK, BLOCK_SHINGLES = 256, 2**19
#: A task takes blocks of about so many members and shingles, and looks at so many pairs at once.
TASK_ROWS, TASK_SHINGLES, PAIRS = 4000, 2**21, 16_000

_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_B = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The REGISTERS registers of a set of 64-bit hashes; of the union of sets, they are the larger of theirs."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        least = np.minimum(least, (np.multiply.outer(_A, low[k : k + 4096]) + _B[:, None]).min(axis=1))
    e = -np.log1p(-(least.astype(float) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of rows of registers, given both sets' sizes."""
    more, less = (x > y).sum(axis=-1), (x < y).sum(axis=-1)
    u = n_x / (n_x + n_y)
    grid = np.linspace(0, 1, 51)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)[:, None]

    def p(z):
        return np.clip(-np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    above, below = p(u[:, None] - (1 - u)[:, None] * grid), p((1 - u)[:, None] - u[:, None] * grid)
    same = np.clip(1 - above - below, 1e-12, 1)
    fit = more[:, None] * np.log(above) + less[:, None] * np.log(below) + (x.shape[-1] - more - less)[:, None] * np.log(same)
    return grid[np.arange(len(grid)), fit.argmax(axis=1)]


def _sketch(batches, width):
    import hashlib

    import pyarrow as pa

    for batch in C.trimmed(batches):
        for first, data, off in C.byte_slices(batch.column("text")):
            n, mark, reg = [], [], []
            for s in C.shingle_sets(*C.word_hashes(data, off, lower=True), width):
                n.append(len(s))
                mark.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                reg.append(registers(s).tobytes() if len(s) else None)
            ids = batch.column("doc_id").slice(first, len(n))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(reg, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])


def _sets(batches, width):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        for first, data, off in C.byte_slices(batch.column("text")):
            sets = [s.tobytes() for s in C.shingle_sets(*C.word_hashes(data, off, lower=True), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sets)), pa.array(sets, pa.binary())], ["id", "shingles"])


def _spans(group, side):
    """Of rows sorted by group and side, the range of partners of each row: later ones of the group, of the other side if it has one."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, len(group)))
    right = np.add.reduceat(side, begin)
    row = np.arange(len(group))
    end = np.repeat(begin + size, size)
    start = np.where(np.repeat(right, size) > 0, np.maximum(row + 1, np.repeat(begin + size - right, size)), row + 1)
    return np.where(side == 1, end, start), end


def _likely(pdf):
    """Pairs (i, j) of rows of the same block, by PAIRS, that are in different components and may reach the threshold.

    pdf is sorted by block and side. A pair counts only under the first key that its members share.
    """
    start, end = _spans(pdf["block"].to_numpy(), pdf["side"].to_numpy())
    reg = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(-1, REGISTERS)
    n, of, band = pdf["n"].to_numpy(float), pdf["component"].to_numpy(), pdf["band"].to_numpy()
    many = end - start
    until = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, stop), many[at:stop])
        j = np.arange(len(i)) - np.repeat(until[at:stop] - many[at:stop] - (until[at - 1] if at else 0), many[at:stop]) + start[i]
        at = stop
        fit = (of[i] != of[j]) & (np.minimum(n[i], n[j]) >= 0.75 * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        same = reg[i] == reg[j]
        fit = (same.mean(axis=1) >= 0.9 * ESTIMATE) & (same.reshape(len(i), -1, BAND).all(axis=2).argmax(axis=1) == band[i])
        i, j = i[fit], j[fit]
        fit = estimate(reg[i], reg[j], n[i], n[j]) >= ESTIMATE if len(i) else fit[:0]
        yield i[fit], j[fit]


def _sorted(pdf):
    import pandas as pd

    pdf = pdf.assign(block=pd.factorize(pd.MultiIndex.from_frame(pdf[["key", "bi", "bj"]]))[0])
    return pdf.sort_values(["block", "side"], kind="stable", ignore_index=True)


def _candidates(pdf):
    """The rows of pdf that stand in a likely pair, without their registers."""
    pdf = _sorted(pdf)
    hit = np.zeros(len(pdf), bool)
    for i, j in _likely(pdf):
        hit[i] = hit[j] = True
    return pdf.loc[hit, ["key", "bi", "bj", "side", "band", "id", "component", "n"]]


def _reach(x, y, part_of_100):
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= part_of_100 * (len(x) + len(y) - both)


def _forest(pdf, part_of_100):
    """Links (a, b) that full sets confirm: of each block a spanning forest of its components."""
    import pandas as pd

    pdf = _sorted(pdf)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    # a component is named by block, so that blocks stay apart
    top = pd.factorize(pd.MultiIndex.from_frame(pdf[["block", "component"]]))[0]
    found = []
    for i, j in _likely(pdf):
        for x in np.unique(i):
            others = j[i == x]
            others = others[top[others] != top[x]]
            while len(others):
                y = others[0]
                if _reach(sets[x], sets[y], part_of_100):
                    found.append((x, y))
                    top[top == top[y]] = top[x]
                others = others[1:][top[others[1:]] != top[x]]
    ids = pdf["id"].to_numpy()
    x, y = (ids[np.array([p[k] for p in found], int)] for k in (0, 1))
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}, dtype="int64")


def near_components(docs: DataFrame, threshold: int = 75, width: int = 5, ws: C.Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id bigint, text string); see the module's text."""
    ws = ws or C.Workspace(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    every = ws.store(plain.mapInArrow(lambda it: _sketch(it, width), "doc_id long, n_shingles long, digest binary, registers binary"), "sketches")
    usable = every.filter("doc_id is not null and digest is not null")
    classes = ws.store(usable.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    reps = every.join(classes, (every.doc_id == classes.id) & (every.digest == classes.digest), "left_semi")
    reps = ws.store(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers").dropDuplicates(["id"]), "representatives")

    step = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * step + 1, F.lit(step))))
    banded = reps.select("id", "n", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("weight")).filter("many > 1")
    groups = ws.store(banded.join(shared, "key"), "groups")

    own = F.pmod(F.xxhash64("id", "band"), _blocks("many", "weight")).cast("int")
    first = groups.filter(F.col("band") < FIRST_BANDS).select("key", own.alias("bi"), own.alias("bj"), F.lit(0).alias("side"), "band", "id", F.col("id").alias("component"), "n")
    links = _links(ws, first, reps, plain, threshold, width)
    labels = C.components(ws, links)
    links = links.unionByName(_links(ws, _open(ws, groups, labels), reps, plain, threshold, width))
    ws.release(groups)
    labels = C.components(ws, links)
    here = labels.select(F.col("node").alias("id"), F.col("component").alias("top"))
    of_class = classes.join(here, "id", "left").select(F.col("digest").alias("of"), F.coalesce("top", "id").alias("component_id"))
    out = every.drop("registers").join(of_class, every.digest == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _blocks(many, weight):
    return F.ceil(F.greatest(F.col(many) / BLOCK, F.col(weight) / BLOCK_SHINGLES)).cast("int")


def _open(ws, groups, labels):
    """Blocks to compare in groups that span several components: those outside the group's largest one against all."""
    told = groups.join(labels, groups.id == labels.node, "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    told = ws.store(told, "told")
    parts = told.groupBy("key", "component").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    wide = parts.groupBy("key").agg(F.max_by("component", F.struct("many", "component")).alias("bulk"), F.max("many").alias("bulk_many"), F.sum("many").alias("many"), F.sum("weight").alias("weight"), F.count("*").alias("apart"))
    wide = wide.filter("apart > 1").withColumn("blocks", _blocks("many", "weight"))
    # a group of one block is compared whole; else its largest component has blocks of its own, after the others'
    rest = F.greatest(F.lit(1), F.ceil(F.col("blocks") * (F.col("many") - F.col("bulk_many")) / F.col("many"))).cast("int")
    wide = wide.withColumn("rest", rest).withColumn("of_bulk", F.when(F.col("blocks") > 1, F.greatest(F.lit(1), F.col("blocks") - F.col("rest"))).otherwise(0)).select("key", "bulk", "rest", "of_bulk")
    put = told.join(wide, "key")
    inside = (F.col("component") == F.col("bulk")) & (F.col("of_bulk") > 0)
    lot = F.xxhash64("id", "band")
    put = put.withColumn("own", F.when(inside, F.col("rest") + F.pmod(lot, F.greatest(F.col("of_bulk"), F.lit(1)))).otherwise(F.pmod(lot, F.col("rest"))).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("of_bulk") - 1))))
    return put.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "band", "id", "component", "n")


def _links(ws, blocks, reps, plain, threshold, width):
    """Verified links between the components of each block's members, as a spanning forest of each block."""
    blocks = ws.store(blocks, "blocks")
    lot = F.xxhash64("key", "bi", "bj")
    tasks = -(-max(blocks.count(), 1) // TASK_ROWS)
    seen = blocks.join(reps.select("id", "registers"), "id").withColumn("task", F.pmod(lot, F.lit(tasks)))
    hits = ws.store(seen.groupBy("task").applyInPandas(_candidates, "key long, bi int, bj int, side int, band int, id long, component long, n long"), "hits")
    ws.release(blocks)
    weight, rows = hits.agg(F.sum("n"), F.count("*")).first()
    ids = ws.store(hits.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = plain.join(C.by_size(ids, ids.count()), "doc_id", "left_semi")
    sets = ws.store(texts.mapInArrow(lambda it: _sets(it, width), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    tasks = max(1, -(-(weight or 0) // TASK_SHINGLES), -(-rows // TASK_ROWS))
    full = hits.join(reps.select("id", "registers"), "id").join(sets, "id").withColumn("task", F.pmod(lot, F.lit(tasks)))
    links = ws.store(full.groupBy("task").applyInPandas(lambda pdf: _forest(pdf, threshold), "a long, b long"), "links")
    ws.release(hits, ids, sets)
    return links


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs of which near_components keeps the document: one of each group, the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together. A row with a null doc_id takes part under a number
    above all ids, made from its text.
    """
    inner, ws = C.Workspace(docs.sparkSession), C.Workspace(docs.sparkSession)
    gone = ws.store(near_components(docs.withColumn("doc_id", C.own_id()), ws=inner).filter("not kept").select("doc_id").distinct(), "dropped")
    inner.close()
    return C.without(docs, gone)


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
r(a, b) as (select doc_id, doc_id from documents union select a, y from r join e on b = x)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)
"""
