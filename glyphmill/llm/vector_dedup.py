"""Near-duplicate vectors by spherical-cap filters with list decoding.

A filter is one direction in a structured random product code: space is cut into BLOCKS blocks of coordinates after a
random rotation, each block has CODE random directions (more where there are more vectors than they part well, as
code_size says), and every choice of one direction per block is a filter. A
vector's list is every filter whose inner product is within reach of its best one; it is decoded by joining the two
halves' partial losses, so no list of all CODE ** BLOCKS filters is walked. Inner products with random directions, and
their differences between two vectors, shrink with the root of the dimension, and the reach with them: so lists are as
long in any dimension, and two vectors at cosine 0.98 share a filter all but surely. Vectors are joined on (label,
filter), then compared in double precision.

Equal vectors of a label are one class, so copies never pair up. Buckets are cut into blocks of BLOCK classes that are
compared block against block. A pair that shares several filters is counted only under the smallest of them; so each
block returns per-vector link counts and a spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null label or
null vec_id, link with nothing and are their own component (a null vec_id: null component, kept false). Vectors of
different lengths don't link. Repeated rows are copies that link with each other. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCKS, CODE, BLOCK, TASK_ROWS = 4, 16, 256, 4000
#: The reach in one dimension; 0.08 in 64.
REACH = 0.64
#: The codebooks grow with the number of different vectors, so that there are so many filters for each and none fills up.
FILTERS = 8


def code_size(vectors: int) -> int:
    """Directions in each block: CODE at least."""
    return max(CODE, int(np.ceil((vectors * FILTERS) ** (1 / BLOCKS))))


def code(dim: int, size: int = CODE) -> tuple[np.ndarray, np.ndarray]:
    """A rotation of dim coordinates (padded to a multiple of BLOCKS) and the BLOCKS codebooks of size directions."""
    rng = np.random.default_rng(dim)
    wide = -(-dim // BLOCKS) * BLOCKS
    turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim]
    books = rng.normal(size=(BLOCKS, size, wide // BLOCKS))
    return turn, books / np.linalg.norm(books, axis=2, keepdims=True)


def reach_of(dim: int) -> float:
    return REACH / float(np.sqrt(dim))


def decode(unit: np.ndarray, turn: np.ndarray, books: np.ndarray) -> list[np.ndarray]:
    """For each row of unit vectors, the sorted numbers of its filters."""
    dots = np.einsum("bmd,mkd->bmk", (unit @ turn).reshape(len(unit), BLOCKS, -1), books)
    loss = dots.max(axis=2, keepdims=True) - dots
    reach = reach_of(unit.shape[1])
    left = (loss[:, 0, :, None] + loss[:, 1, None, :]).reshape(len(unit), -1)
    right = (loss[:, 2, :, None] + loss[:, 3, None, :]).reshape(len(unit), -1)
    out = []
    for x, y in zip(left, right, strict=True):
        i, j = np.flatnonzero(x <= reach), np.flatnonzero(y <= reach)
        p, q = np.nonzero(x[i][:, None] + y[j] <= reach)
        out.append(np.sort(i[p].astype(np.int64) * books.shape[1] ** 2 + j[q]))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decode(batches, size):
    import pyarrow as pa

    books: dict[int, tuple] = {}
    for batch in C.trimmed(batches):
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            if not part.num_rows:
                continue
            vectors = [np.array(v, float) for v in part.column("v").to_pylist()]
            dims = np.array([len(v) for v in vectors])
            lists: list = [None] * len(vectors)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                books.setdefault(int(dim), code(int(dim), size))
                for i, found in zip(at, decode(_unit(np.stack([vectors[i] for i in at])), *books[int(dim)]), strict=True):
                    lists[i] = found
            cols = [part.column(c) for c in ("cid", "label", "n", "low")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(dims, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["cid", "label", "n", "low", "dim", "vector", "filters"])


def _compare(pdf, least):
    """Link counts and forests of the blocks in pdf."""
    import pandas as pd

    out = []
    for (_, dim, f, bi, bj), g in pdf.groupby(["label", "dim", "filter", "bi", "bj"], sort=False):
        if len(g) < 2:
            continue
        v = np.frombuffer(b"".join(g["vector"]), float).reshape(len(g), dim)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.sqrt((v * v).sum(axis=1))
        link = (v @ v.T) / (norm[:, None] * norm) >= least
        np.fill_diagonal(link, False)
        if bi != bj:
            side = g["side"].to_numpy()
            link &= side[:, None] != side
        if not link.any():
            continue
        hit = np.flatnonzero(link.any(axis=1))
        link, g = link[np.ix_(hit, hit)], g.iloc[hit]
        lists = [x[x < f] for x in g["filters"]]
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        if len(names):
            has = np.zeros((len(g), len(names)), np.float32)
            has[np.repeat(np.arange(len(g)), [len(x) for x in lists]), at] = 1
            link &= (has @ has.T) == 0
        n, low = g["n"].to_numpy(), g["low"].to_numpy()
        links = link @ n
        root = low.copy()
        while True:
            new = np.minimum(root, np.where(link, root, np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        out.append(pd.DataFrame({"cid": g["cid"].to_numpy(), "links": links, "a": low, "b": root})[links > 0])
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, "int64") for c in ("cid", "links", "a", "b")})


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label)."""
    ws = C.Workspace(vectors.sparkSession)
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.filter("sound").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = ws.store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = code_size(classes.count())
    coded = ws.store(classes.mapInArrow(lambda it: _decode(it, size), "cid long, label string, n long, low long, dim int, vector binary, filters array<long>"), "coded")
    put = coded.select("label", "dim", "cid", F.explode("filters").alias("filter"))
    many = put.groupBy("label", "dim", "filter").agg(F.count("*").alias("many")).filter("many > 1")
    put = put.join(many, ["label", "dim", "filter"]).withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    put = put.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    put = put.select("label", "dim", "filter", "cid", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    put = ws.store(put, "buckets")
    tasks = -(-max(put.count(), 1) // TASK_ROWS)
    put = put.join(coded.select("cid", "n", "low", "vector", "filters"), "cid")
    put = put.withColumn("task", F.pmod(F.xxhash64("label", "dim", "filter", "bi", "bj"), F.lit(tasks)))
    told = ws.store(put.groupBy("task").applyInPandas(lambda pdf: _compare(pdf, least), "cid long, links long, a long, b long"), "links")
    labels = C.components(ws, told.filter("a <> b").select("a", "b").distinct())
    per_class = told.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(per_class, "cid", "left").join(labels, classes.low == labels.node, "left")
    known = known.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    out = rows.join(known, F.col("sound") & (rows.label == known.l) & (rows.v == known.w), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from v where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
e as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(a, b) as (select vec_id, vec_id from v union select a, y from r join e on b = x)
select vec_id, coalesce(k.n, 0) as n_links, component_id, vec_id = component_id as kept
from (select a as vec_id, min(b) as component_id from r group by a) left join (select x as vec_id, count(*) as n from e group by x) k using (vec_id)
"""
