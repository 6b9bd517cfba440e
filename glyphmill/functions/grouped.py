"""Rows by group, many groups in an Arrow batch: for small groups, where a batch for each costs more than the work; and a batch in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.functions.shipping import ship, spread

#: So many groups are Python objects at a time.
GROUPS = 64

#: So many bytes of text are cut at a time.
CUT_BYTES = 4 << 20


def slices(batch, column: str, most: int = CUT_BYTES):
    """The rows of batch in turn, of which the column has at most so many bytes at a time, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def each_group(left: DataFrame, right: DataFrame, key: str, one: Callable, out: str, together: bool = False) -> DataFrame:
    """key and what one tells of each group: one(left, right) has the columns of its rows as lists, in no order, and gives rows of out.
    With together it has a list of such pairs, of up to GROUPS groups, and gives the rows of each.

    A null key is a group as well. Groups without rows on one of the sides give none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(left.sparkSession)
    body = lambda d: F.struct(*(c for c in d.columns if c != key))
    a, b = left.select(key, body(left).alias("a")), right.select(key, body(right).alias("b"))
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    both = a.select(key, "a", none(b, "b")).unionByName(b.select(key, none(a, "a"), "b"))
    held = spread(both, key).groupBy(key).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).filter("size(a) > 0 and size(b) > 0")
    fields = StructType.fromDDL(out).fields
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def columns(lists):
        import numpy as np

        flat = lists.flatten()
        names = [f.name for f in flat.type]
        cols = [flat.field(n).to_pylist() for n in names]
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        return [{n: c[i:j] for n, c in zip(names, cols, strict=True)} for i, j in zip([0, *ends], ends, strict=False)]

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, GROUPS):
                some = batch.slice(k, GROUPS)
                at, told = [], []
                pairs = list(zip(columns(some.column("a")), columns(some.column("b")), strict=True))
                for n, rows in enumerate(one(pairs) if together else (one(x, y) for x, y in pairs)):
                    at += [n] * len(rows)
                    told += rows
                cols = list(zip(*told, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([some.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True))], [key, *(n for n, _ in kinds)])

    return held.mapInArrow(scan, f"{key} {left.schema[key].dataType.simpleString()}, {out}")
