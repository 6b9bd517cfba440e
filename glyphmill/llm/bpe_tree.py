"""Byte-level BPE of whole texts by tree concatenation, and back.

A text is halved until its parts have at most LEAF characters, wherever that cuts it, be it within a word that nothing
splits. The parts are encoded by themselves, those of a text of more than SPREAD characters in tasks of their own. Then
neighbours are joined up the tree: a window of a few tokens on both sides of the join is encoded again and grows until
both sides agree; see joined. The result is exactly that of encoding the whole text at once.

Nulls and empty texts have no tokens. Ties don't occur: merges have one rank each. Rows that repeat are rows of the
result each; a null doc_id is kept. A text of any length is whole; one without any white space costs windows, not a second
encoding. Empty tables give empty results; columns named in keep come along under their own names, and the result's own
column takes underscores where they clash.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Characters of a part that is encoded at once, and of a part that has a task's row of its own.
LEAF, SPREAD = 4_096, 65_536
#: Tokens on either side of a join in the first window; it doubles.
WINDOW = 8
#: Bytes before a join, and before a window's end, where tokens are not trusted: a special token or an apostrophe's ending may go on behind.
MARGIN = 32
#: Fixed value: the pattern by which the vocabulary's tokenizer splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NAME = "byte_bpe_50k.json"


class Codec:
    """A byte-level BPE vocabulary, read from a tokenizer file whose merges are in order of rank."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = dict(zip(ranks.values(), ranks.keys(), strict=True)) | {i: t.encode() for t, i in self.special.items()}
        self.table = [table[i] for i in range(len(table))]
        self.sizes = np.array([len(t) for t in self.table])
        self.first = np.array([t[0] for t in self.table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.digits = [str(i) for i in range(len(self.table))]
        self._tokenizer = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def at_once(self, text: str, special: bool = True) -> np.ndarray:
        if special and self.special:
            return self._tokenizer.encode_to_numpy(text, allowed_special="all")
        return self._tokenizer.encode_to_numpy(text, disallowed_special=())

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.table[i] for i in ids.tolist()]).decode("utf-8")

    def joined(self, left: np.ndarray, right: np.ndarray, special: bool = True) -> np.ndarray:
        """The tokens of the text whose parts, cut at a character, have the tokens left and right.

        The window starts at a token of left and ends before one of right. Its tokens replace those around the join if
        the first one is left's token there, and if some token after the join begins where the same token of right
        begins, MARGIN before the window's end; or if the window reaches that end of the text. That is exact: a row of
        tokens is the encoding of its bytes if each pair of neighbours is the encoding of theirs, and pairs are taken
        over from left, from the window or from right only. The words that the pattern cuts are the same behind a
        place that isn't an apostrophe, whatever stands before it.
        """
        reach = WINDOW
        while True:
            i, tail = max(0, len(left) - reach), int(self.sizes[left[max(0, len(left) - reach) :]].sum())
            while i and (tail < MARGIN or self.first[left[i]] & 0xC0 == 0x80 or self.first[left[i]] == 0x27):
                i -= 1
                tail += int(self.sizes[left[i]])
            j = min(len(right), reach)
            while j < len(right) and self.first[right[j]] & 0xC0 == 0x80:
                j += 1
            if not i:
                tail = int(self.sizes[left].sum())
            window = self.at_once(self.text(np.concatenate([left[i:], right[:j]])), special)
            if not i or window[0] == left[i]:
                if j == len(right):
                    return np.concatenate([left[:i], window])
                ends = np.cumsum(self.sizes[window])
                mine, theirs = ends - self.sizes[window], tail + np.cumsum(self.sizes[right[:j]]) - self.sizes[right[:j]]
                both, k, m = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
                good = (both <= ends[-1] - MARGIN) & (window[k] == right[m]) & (self.first[window[k]] != 0x27)
                if good.any():
                    at = int(np.argmax(good))
                    return np.concatenate([left[:i], window[: k[at]], right[m[at] :]])
            reach *= 2

    def tree(self, parts: list[np.ndarray], special: bool = True) -> np.ndarray:
        """The tokens of neighbouring parts, joined pair by pair, level by level."""
        while len(parts) > 1:
            parts = [self.joined(parts[k], parts[k + 1], special) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.uint32)

    def encode(self, text: str, special: bool = True, leaf: int = LEAF) -> np.ndarray:
        return self.tree([self.at_once(t, special) for t in halves(text, leaf)], special)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i]:bounds[i + 1]]; bytes that are no character become U+FFFD."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.bytes[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def halves(text: str, leaf: int) -> list[str]:
    """The text cut in the middle, and the halves again, until none has more than leaf characters."""
    if len(text) <= leaf:
        return [text] if text else []
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    """The vocabulary at path; without one, the public vocabulary NAME where its package is installed, on each machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    return Codec(path)


def _list(arrays: list[np.ndarray]):
    import pyarrow as pa

    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int32)))


def _encoded(batches, name, path, special, leaf):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        for rows in C.parts(batch):
            ids = [codec(path).encode(t or "", special, leaf) for t in rows.column("text").to_pylist()]
            kept = [n for n in rows.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), _list(ids)], [*kept, name])


def _cut(batches, size):
    import pyarrow as pa

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = halves(text, size)
            for k in range(0, len(parts), 16):
                some = parts[k : k + 16]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.string())], ["key", "no", "text"])


def _tree(group, path, special):
    import pyarrow as pa

    rows = group.sort_by("no")
    ids = codec(path).tree([np.array(x.values, np.uint32) for x in rows.column("ids")], special)
    return pa.Table.from_arrays([rows.column("key").slice(0, 1).combine_chunks(), _list([ids])], ["key", "ids"])


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, special: bool = True, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """The columns keep of docs(text, ...) and ids array<int>, the tokens of the whole text.

    special: whether strings of special tokens within a text are those tokens, or plain text. Long texts are encoded
    once for all rows that have them, part by part; a part's row goes to any task, and a text's tokens meet for the joins.
    """
    C.Workspace(docs.sparkSession)
    named = {n: f"c{k}" for k, n in enumerate(keep)}
    rows = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in named.items()), F.col("text").cast("string").alias("text"))
    name = C.free_name(docs.select(*(f"`{n}`" for n in keep)), "ids")
    out = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    long = F.coalesce(F.char_length("text") > spread, F.lit(False))
    whole = rows.filter(~long).mapInArrow(lambda it: _encoded(it, "ids", path, special, leaf), out)
    keyed = rows.filter(long).withColumn("key", F.sha2("text", 256))
    parts = keyed.select("key", "text").mapInArrow(lambda it: _cut(it, spread), "key string, no int, text string")
    parts = parts.groupBy("key", "no").agg(F.first("text").alias("text"))
    told = parts.mapInArrow(lambda it: _encoded(it, "ids", path, special, leaf), "key string, no int, ids array<int>")
    told = told.groupBy("key").applyInArrow(lambda g: _tree(g, path, special), "key string, ids array<int>")
    joined = keyed.join(told, "key").select(*named.values(), "ids")
    return whole.unionByName(joined).select(*(F.col(c).alias(n) for n, c in named.items()), F.col("ids").alias(name))


def _decoded(batches, path):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        ids = batch.column("ids")
        off = np.concatenate([[0], np.cumsum([x or 0 for x in ids.value_lengths().to_pylist()])])
        texts = codec(path).decode(ids.flatten().to_numpy(zero_copy_only=False), off)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens(ids array<int>, ...) and decoded, the text of the ids, special tokens included; a null list gives an empty text."""
    C.Workspace(tokens.sparkSession)
    return tokens.mapInArrow(lambda it: _decoded(it, path), T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for every row of docs."""
    both = decode(encode(docs, path=path), path)
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
