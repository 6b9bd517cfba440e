"""Alignment of two tokenizers' tokens of the same text, by the bytes that they cover.

A is a byte-level BPE of space + text, B a sentencepiece model of text, whose own space in front makes the bytes equal;
special tokens' strings are plain text to both. Neither has a token over a place where a visible ASCII character meets a
space, so a text is a row of stretches between such places, and all that holds within a stretch holds wherever it
stands: each different stretch of a slice of an Arrow batch is encoded once. DuckDB then joins the two interval tables of
a block of stretches: ASOF joins find the first and the last token of A that a token of B meets, a join over that range
gives all overlaps, those that end together are the links, and window sums over their ends number the groups. Counts of
id pairs in a slice are added up over slices in Spark, and what Spark finds goes back to the slices that have the pair,
by joins.

Nulls, empty texts and texts whose bytes either tokenizer changes (as a U+2581 is) have no tokens: zeros and an empty
string. Ties for the best pair of a B id all count. Rows that repeat count each; a null doc_id is kept. A text of any
length is whole; one without a cut is one stretch, encoded by tree concatenation for A. Empty tables give empty results,
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe_tree as T
from . import common as C
from . import packed as P

NAME_B = "piece_bpe_32k.model"
#: Bytes of text in a slice, the unit of partial counts; stretches whose tokens are joined at once.
SLICE, BLOCK = 4_000_000, 40_000
#: Memory that DuckDB may use in a task; a block needs a part of it, and nothing is written to a machine's own disk.
MEMORY = "300MB"

_SLICED = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, n_units array<int>, "
    "units binary, link_unit binary, link_pair binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
)

#: Tokens of B with the first and the last token of A that they meet; and all pairs that overlap.
_MET = "create or replace temp table met as select b.k, b.unit, b.id, b.s, b.e, f.k as first, l.k as last from b asof join a f on b.s >= f.s asof join a l on b.e > l.s"
_OVERLAPS = """
create or replace temp table overlapping as
select a.k as ka, m.k as kb, a.unit, a.id as a, m.id as b, least(a.e, m.e) - greatest(a.s, m.s) as shared, a.e = m.e as together
from (select *, unnest(range(first, last + 1)) as ka from met) m join a on a.k = m.ka"""
#: A group begins behind each end that both sides have.
_GROUPS = """
select coalesce(sum((o.{k} is not null)::int) over (order by {x}.k rows between unbounded preceding and 1 preceding), 0)::bigint as g
from {x} left join (select {k} from overlapping where together) o on o.{k} = {x}.k order by {x}.k"""
_LINKS = "select unit, a, b from overlapping where together order by ka"


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a space, so texts can't be cut before spaces")
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(t) for t in self.table])
        self.space = self.model.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of stretches that begin with a space, which the model puts there itself, and how many each has."""
        rows = self.model.encode([t[1:] for t in stretches], num_threads=1)
        for k, t in enumerate(stretches):
            if len(t) == 1:
                rows[k] = [self.space]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


@lru_cache(2)
def pieces(path: str | None = None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME_B)
    return Pieces(path)


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The stretches of space + text for each text: numbers into the list of different ones, and how many each text has."""
    import pandas as pd

    words, sizes = [], []
    for t in texts:
        own = t.split(" ")
        words += own
        sizes.append(len(own))
    codes, different = pd.factorize(np.array([*words, ""], dtype=object)[:-1])
    visible = np.array([w != "" and "!" <= w[-1] <= "~" for w in different], bool)
    first = np.zeros(len(words), bool)
    begin = np.cumsum(sizes) - np.array(sizes, np.int64)
    first[1:] = visible[codes[:-1]]
    first[begin] = True
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(words))
    units, found = codes[at].astype(np.int64), {}
    for k in np.flatnonzero(ends - at > 1).tolist():
        units[k] = found.setdefault(" ".join(words[at[k] : ends[k]]), len(different) + len(found))
    strings = [*different, *found]
    used, units = np.unique(units, return_inverse=True)
    return units, np.add.reduceat(first.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64), [" " + strings[k] for k in used.tolist()]


def _encoded(codec: T.Codec, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A's tokens of all stretches and how many each has. Those that end in a visible ASCII character are encoded many at once: no token goes on into the next."""
    parts: list[np.ndarray] = [np.zeros(0, np.int64)]
    counts: list[np.ndarray] = [np.zeros(0, np.int64)]

    def put(row: list[str]) -> None:
        if row:
            ids = codec.at_once("".join(row), False)
            cuts = np.searchsorted(np.cumsum(codec.sizes[ids]), np.cumsum([len(t.encode()) for t in row])) + 1
            parts.append(ids)
            counts.append(np.diff(cuts, prepend=0))

    row: list[str] = []
    size = 0
    for t in strings:
        if "!" <= t[-1] <= "~" and len(t) <= T.LEAF:
            row.append(t)
            size += len(t)
            if size <= T.LEAF:
                continue
            put(row)
        else:
            put(row)
            parts.append(codec.encode(t, False))
            counts.append(np.array([len(parts[-1])]))
        row, size = [], 0
    put(row)
    return np.concatenate(parts).astype(np.int64), np.concatenate(counts)


def _unchanged(ids: np.ndarray, counts: np.ndarray, table: list[bytes], sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """For each stretch whether its tokens' bytes are its own."""
    total = np.concatenate([[0], np.cumsum(sizes[ids])])
    ends = np.cumsum(counts)
    texts = [table[i] for i in ids.tolist()]
    if (total[ends] == np.cumsum([len(r) for r in raw])).all() and b"".join(texts) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([b"".join(texts[e - n : e]) == r for n, e, r in zip(counts.tolist(), ends.tolist(), raw, strict=True)], bool)


def _tiled(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
    """The interval table of the tokens of stretches laid end to end."""
    import pyarrow as pa

    ends = np.cumsum(sizes[ids])
    return pa.table({"k": np.arange(len(ids)), "unit": np.repeat(np.arange(len(counts)), counts), "id": ids, "s": ends - sizes[ids], "e": ends})


def _written(a, b, ga: np.ndarray, gb: np.ndarray, digits: list[str]) -> list[str]:
    """Each stretch's groups as a1,a2|b1;a3|b2,b3, from both tables' tokens and their group numbers."""
    n, m = len(ga), len(gb)
    if not n:
        return []
    ids, unit, group, side = np.empty(n + m, np.int64), np.empty(n + m, np.int64), np.empty(n + m, np.int64), np.zeros(n + m, np.int64)
    at_a, at_b = np.arange(n) + np.searchsorted(gb, ga, "left"), np.arange(m) + np.searchsorted(ga, gb, "right")
    for at, table, g in ((at_a, a, ga), (at_b, b, gb)):
        ids[at], unit[at], group[at] = table.column("id").to_numpy(), table.column("unit").to_numpy(), g
    side[at_b] = 1
    new_unit, new_group, new_side = (np.append(x[1:] != x[:-1], True) for x in (unit, group, side))
    mark = np.where(new_unit, 0, np.where(new_group, 1, np.where(new_side, 2, 3)))
    marks = ("", ";", "|", ",")
    texts = [digits[i] + marks[k] for i, k in zip(ids.tolist(), mark.tolist(), strict=True)]
    ends = np.flatnonzero(new_unit) + 1
    return ["".join(texts[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Slice:
    """The alignment of one slice's texts."""

    def __init__(self, texts: list[str | None], path_a: str | None, path_b: str | None):
        import duckdb

        a, b = T.codec(path_a), pieces(path_b)
        given = [k for k, t in enumerate(texts) if t]
        self.units, counts, strings = stretches([texts[k] for k in given])
        self.n_units = np.zeros(len(texts), np.int64)
        self.n_units[given] = counts
        good = np.ones(len(strings), bool)
        self.told: list[str] = []
        sizes, links = [], []
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for first in range(0, len(strings), BLOCK):
                some = strings[first : first + BLOCK]
                raw = [t.encode() for t in some]
                in_a, in_b = _encoded(a, some), b.encode(some)
                same = _unchanged(*in_b, b.table, b.sizes, raw) & _unchanged(*in_a, a.table, a.sizes, raw)
                good[first : first + len(some)] = same
                # a stretch that a tokenizer changes has no tokens, nor has its text
                in_a, in_b = ((ids[np.repeat(same, n)], n * same) for ids, n in (in_a, in_b))
                block, link = self._joined(con, in_a, in_b, a, b)
                sizes.append(block)
                links.append(link + [[first], [0], [0]])
        self.n_a, self.n_b, self.n_groups = np.concatenate([np.zeros((3, 0), np.int64), *sizes], axis=1)
        self._count(good, np.concatenate([np.zeros((3, 0), np.int64), *links], axis=1), len(texts))

    def _joined(self, con, in_a: tuple, in_b: tuple, a: T.Codec, b: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """n_a, n_b and n_groups of a block's stretches, and its links (unit, a, b)."""
        tables = {"a": _tiled(*in_a, a.sizes), "b": _tiled(*in_b, b.sizes)}
        for name, table in tables.items():
            con.register("arrow", table)
            con.execute(f"create or replace temp table {name} as from arrow")
        con.execute(_MET)
        con.execute(_OVERLAPS)
        ga, gb = (con.sql(_GROUPS.format(x=x, k=f"k{x}")).fetchnumpy()["g"] for x in "ab")
        link = con.sql(_LINKS).fetchnumpy()
        n_a, n_b = in_a[1], in_b[1]
        written = _written(tables["a"], tables["b"], ga, gb, a.digits)
        full = iter(written)
        self.told += [next(full) if n else "" for n in n_a.tolist()]
        ends = np.cumsum(n_a)[n_a > 0] - 1
        n_groups = np.zeros(len(n_a), np.int64)
        n_groups[n_a > 0] = np.diff(np.concatenate([[0], ga[ends] + 1])) if len(ends) else 0
        return np.stack([n_a, n_b, n_groups]), np.stack([link[c].astype(np.int64) for c in ("unit", "a", "b")])

    def _count(self, good: np.ndarray, links: np.ndarray, n_texts: int) -> None:
        at = np.repeat(np.arange(n_texts), self.n_units)
        bad = np.bincount(at, weights=~good[self.units], minlength=n_texts) > 0 if len(at) else np.zeros(n_texts, bool)
        self.units = self.units[~bad[at]]
        self.n_units[bad] = 0
        weight = np.bincount(self.units, minlength=len(good))
        links = links[:, weight[links[0]] > 0]
        key, self.link_pair = np.unique(links[1] << 32 | links[2], return_inverse=True)
        self.link_unit = links[0]
        self.pair_a, self.pair_b = key >> 32, key & (2**32 - 1)
        self.pair_n = np.bincount(self.link_pair, weights=weight[links[0]], minlength=len(key)).astype(np.int64)
        self.n_links = np.bincount(self.link_unit, minlength=len(good))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its stretches' values."""
        return summed(values, self.units, self.n_units)

    def groups(self):
        """For each text its groups, as a1,a2|b1;a3|b2,b3."""
        rows, ends = [self.told[u] for u in self.units.tolist()], np.cumsum(self.n_units)
        for n, e in zip(self.n_units.tolist(), ends.tolist(), strict=True):
            yield ";".join(rows[e - n : e])


def summed(values: np.ndarray, units: np.ndarray, n_units: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values[units])]).astype(np.int64)
    ends = np.cumsum(n_units)
    return total[ends] - total[ends - n_units]


def _array(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _slices(batches, path_a, path_b):
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 32
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 3, *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SLICED.split(", ")]
    for batch in C.trimmed(batches):
        for rows in C.parts(batch, SLICE):
            s = Slice(rows.column("text").to_pylist(), path_a, path_b)
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in s.groups()]
            row = [chunk, rows.column("doc_id").to_pylist(), *(s.sums(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)), sha, s.n_units.astype(np.int32)]
            row += [P.squeezed(s.units.astype(np.int32).tobytes()), P.planes(s.link_unit.astype(np.int32)), P.planes(s.link_pair.astype(np.int32)), s.pair_a, s.pair_b, s.pair_n]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
            chunk += 1


def _finish(slices, told):
    """The rows of a slice's documents, given the corpus-wide counts of its pairs: told has (of, k, total, best)."""
    import pyarrow as pa

    row = slices.slice(0, 1).to_pylist()[0]
    total, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
    k = _array(told, "k")
    total[k], best[k] = _array(told, "total"), _array(told, "best")
    units = np.frombuffer(P.unsqueezed(row["units"]), np.int32)
    link_unit, link_pair = (P.unplanes(row[n], np.int32) for n in ("link_unit", "link_pair"))
    n = int(units.max()) + 1 if len(units) else 0
    n_units = np.array(row["n_units"], np.int64)
    by_unit = []
    for of_pair in (best, total):
        of_unit = np.zeros(n, np.int64)
        np.add.at(of_unit, link_unit, of_pair[link_pair])
        by_unit.append(summed(of_unit, units, n_units))
    cols = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.Table.from_arrays([*cols, pa.array(by_unit[0], pa.int64()), pa.array(by_unit[1], pa.int64()), pa.array(row["sha"], pa.string())], names)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _pairs(sliced: DataFrame) -> DataFrame:
    each = sliced.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("k", "p"))
    return each.select("chunk", "k", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def _totals(pairs: DataFrame) -> DataFrame:
    """a, b, total and best: whether no A id has a higher total with this B id (a window of as many rows as A has ids, at most)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return counts.withColumn("best", (F.col("total") == F.max("total").over(Window.partitionBy("b"))).cast("long"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs(doc_id, text, ...)."""
    ws = C.Workspace(docs.sparkSession)
    sliced = ws.store(_rows(docs).mapInArrow(lambda it: _slices(it, path_a, path_b), _SLICED), "slices")
    pairs = _pairs(sliced)
    told = pairs.join(_totals(pairs), ["a", "b"]).select(F.col("chunk").alias("of"), "k", "total", "best")
    kept = sliced.drop("pair_a", "pair_b", "pair_n")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return kept.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_finish, out)


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """a, b, total, best (0 or 1): how often tokens of these ids end together in all of docs."""
    C.Workspace(docs.sparkSession)
    return _totals(_pairs(_rows(docs).mapInArrow(lambda it: _slices(it, path_a, path_b), _SLICED)))


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and groups, as a1,a2|b1;a3|b2,b3, of every row of docs."""
    import pyarrow as pa

    C.Workspace(docs.sparkSession)

    def told(batches):
        for batch in C.trimmed(batches):
            for rows in C.parts(batch, SLICE):
                s = Slice(rows.column("text").to_pylist(), path_a, path_b)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(s.groups()), pa.string())], ["doc_id", "groups"])

    return _rows(docs).mapInArrow(told, "doc_id long, groups string")
