"""What the operators of this subpackage share: the shared work folder, hashing of words, joins by checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.shipping import ship

#: A word is a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The largest id table that may be broadcast: 2 million bigints are about 32 MB as a hash relation.
BROADCAST_ROWS = 2_000_000
#: The most bytes of an Arrow batch, set where the session has Spark's default of 64 MB.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8388608b"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_seed = np.random.default_rng(20240229)
_BYTE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Workspace:
    """Tables written to the folder that driver and executors share (spark.checkpoint.dir), so lineage ends there.

    Where that setting is missing, a local master gets a folder of its own, as in tests; a cluster gets an error, since
    its machines would each write to a folder that the others don't see.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="glyphmill-")
            spark.conf.set("spark.checkpoint.dir", root)
        # Arrow batches to Python workers are bounded by bytes as well as by rows; the setting changes no result
        if spark.conf.get(BATCH_SETTING) in ("67108864b", "64MB", "67108864"):
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        self.spark, self.root = spark, f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._glyphmill_path = path
        return out

    def release(self, *stored: DataFrame) -> None:
        """Deletes stored tables that no later plan reads."""
        for df in stored:
            self._delete(df._glyphmill_path)

    def close(self) -> None:
        """Deletes all tables of this workspace."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_id():
    """doc_id; for a row without one, a number above all real ids from its text, so that a stage can name the row."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.xxhash64("text").bitwiseAND(F.lit(2**61 - 1)))


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it none of docs' columns (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose own_id is not in the stored table gone(doc_id); all columns stay as they are."""
    own = free_name(docs, "own_id")
    return docs.withColumn(own, own_id()).join(by_size(gone.select(F.col("doc_id").alias(own)), gone.count()), own, "left_anti").select(docs.columns)


def by_size(ids: DataFrame, rows: int) -> DataFrame:
    """ids with a broadcast hint if it has few enough rows (counted by the caller); else as it is, for a shuffle join."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def drawn(rows: DataFrame, each: int, languages: int) -> DataFrame:
    """Of rows(doc_id, lang, text, lot) at most each documents of every one of the commonest languages, those of least lot.

    lot is a hash of doc_id. A cut of the lots that leaves about four times as many goes first, so that no language's
    rows meet in one task.
    """
    common = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages).select(F.col("lang").alias("of"), "docs")
    part = F.pmod(F.xxhash64("lot"), F.lit(2**30)) / 2.0**30
    few = rows.join(F.broadcast(common), F.col("lang").eqNullSafe(F.col("of"))).withColumn("part", part)  # one row a language
    few = few.filter(F.col("part") * F.col("docs") <= 4 * each + 40).dropDuplicates(["doc_id", "lang"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "doc_id"))
    return few.withColumn("place", place).filter(F.col("place") <= each).drop("of", "docs", "part", "place")


def trim() -> None:
    """Gives the worker's freed memory back to the system; the worker lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def trimmed(batches):
    """The batches of a task, and trim() at their end."""
    try:
        yield from batches
    finally:
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def parts(batch, limit: int = 1_000_000):
    """The batch in slices of about limit bytes of its column text, of a row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def byte_slices(column, limit: int = 2_000_000):
    """Cuts an Arrow string column into (first row, bytes, row offsets) of about limit bytes; a null has no bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts data[off[i]:off[i + 1]], and each text's first place among them (one more than texts)."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(solid)
    heads = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    terms = (_BYTE_LOWER if lower else _BYTE)[data[at]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, heads)), bounds


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in a row."""
    out = parts[0] + np.uint64(len(parts))
    for x in parts[1:]:
        out = out * _STEP + x
    return mix(out)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int = 5):
    """For each text its sorted distinct shingle hashes; a text of fewer words has all of them as its one shingle, an empty one has none."""
    n = len(words)
    full = combine([words[k : n - width + 1 + k] for k in range(width)]) if n >= width else np.zeros(0, np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            yield combine([words[k : k + 1] for k in range(a, b)])
        else:
            yield np.zeros(0, np.uint64)


def components(ws: Workspace, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every end of links(a, b): the smallest node reachable.

    Smallest labels spread along links and are then shortened by looking up the label's own label, until nothing
    changes; so a chain takes about log n rounds. A hot node's links are only joined and reduced to a minimum, never
    gathered.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    labels = ws.store(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        told = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        spread = labels.join(told, labels.node == told.x).select("node", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = ws.store(spread.join(up, "mid", "left").select("node", "was", F.least("mid", F.coalesce("top", "mid")).alias("component")), "labels")
        ws.release(labels)
        changed = new.filter("was <> component").limit(1).count()
        labels, held = new.select("node", "component"), new
        labels._glyphmill_path = held._glyphmill_path
        if not changed:
            return labels
