"""Documents dealt to chunks of bounded size, and messages between chunks and shards, as compressed columns.

A row each for an n-gram would be several times the text. A chunk holds its texts compressed together; what it sends to
a shard is one message of sorted, difference-coded numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEALT = "chunk long, ids array<long>, tags array<string>, sizes array<int>, texts binary"


def squeezed(data: bytes, level: int = 1) -> bytes:
    """data compressed, after its length."""
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, place by place, so that compression meets runs of zeros."""
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueezed(b), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _bundle(batches, chunks):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        # the row's place parts repeated rows
        chunk = (batch.column("chunk").to_numpy() + np.arange(batch.num_rows)) % chunks
        order = np.argsort(chunk, kind="stable")
        rows = batch.take(pa.array(order))
        names, at = np.unique(chunk[order], return_index=True)
        cells: list[tuple] = []
        for name, a, b in zip(names, at, [*at[1:], len(order)], strict=True):
            texts = [t.encode() for t in rows.column("text").slice(a, b - a).to_pylist()]
            ids, tags = (rows.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "tag"))
            cells.append((int(name), ids, tags, [len(t) for t in texts], squeezed(b"".join(texts), 3)))
        cols = list(zip(*cells, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "ids", "tags", "sizes", "texts"])


def tasks(plain: DataFrame, groups: int, each: int = 4) -> int:
    """Partitions for so many groups: as many as the session's setting, but never so few that one has more than about each groups."""
    return max(1, min(groups, int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-groups // each))


def deal(plain: DataFrame, chunks: int) -> DataFrame:
    """Rows DEALT of plain(doc_id bigint, tag, text not null): a row for what an Arrow batch has for a chunk, chunks together.

    The number of partitions follows the number of chunks, so that a task doesn't grow with the corpus.
    """
    dealt = plain.select("doc_id", "tag", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    return dealt.mapInArrow(lambda it: _bundle(it, chunks), DEALT).repartition(tasks(plain, chunks), "chunk")


def unbundle(group):
    """A chunk's texts as one Arrow column, its ids and its tags."""
    import pyarrow as pa

    sizes = np.concatenate([np.zeros(1, np.int64), *(np.array(x, np.int64) for x in group.column("sizes").to_pylist())])
    data = b"".join(map(unsqueezed, group.column("texts").to_pylist()))
    off = np.cumsum(sizes)
    ids, tags = ([x for c in group.column(name).to_pylist() for x in c] for name in ("ids", "tags"))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(data)), pa.array(ids, pa.int64()), pa.array(tags, pa.string())
