"""Language identification by a string kernel.

The kernel is a blended spectrum of presence: S(x) is the set of letter n-grams of 1 to 3 symbols in x, and
k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|). LANDMARKS pieces of training text span a Nystroem map, and one ridge
regression for each language is solved in it, against the rest. The map, the landmarks' presence rows and the
regressions are folded into one matrix from n-grams to languages, so that a batch of texts is scored by one product of
its presence rows with that matrix. The score is the winner's regression value, from -1..1 brought to 0..1.

Symbols: letters in lower case, the ALPHABET commonest of the training text each their own, rarer ones together; every
run of other characters is one blank. Only text is read for a prediction.

Learning uses a bounded sample: of the rows that may be learnt from, at most PER_LANGUAGE for each of the LANGUAGES
commonest languages, drawn by a hash of doc_id; of each text a stretch of at most LEARN_CHARS from a place that the hash
draws, and of that, pieces of several lengths. Everything that is predicted is read whole.

Defined results: a null text, and one without a letter, is ``und`` with score 0. So is every text if nothing can be
learnt. Repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty result. Ties go to
the language whose code sorts first. A null doc_id is not held out and is not learnt from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.shipping import ship

from . import common as C

PER_LANGUAGE, LANDMARKS, PIECES, RIDGE, ALPHABET = 400, 384, 6, 1e-3, 62
LANGUAGES, LEARN_CHARS = 64, 20_000
FOLDS = 5
#: Numbers in a block of presence rows.
CELLS = 4_000_000
#: The pipeline rejects a text that sets the best and the worst language apart by less than this: it is in none of them.
#: A text in two of the languages stays.
SPREAD = 0.1

_BLANK, _RARE, _BASE = 0, 63, 64
_GRAMS = _BASE + _BASE**2 + _BASE**3
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x10000))], np.int64)
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_table(texts: list[str]) -> np.ndarray:
    """The symbol of every code point below 0x10000: its rank among the texts' letters, from 1."""
    count = np.zeros(0x10000, np.int64)
    for t in texts:
        p = _points(t)
        p = _LOWER[p[p < 0x10000]]
        count += np.bincount(p[_LETTER[p]], minlength=0x10000)
    table = np.where(_LETTER, _RARE, _BLANK).astype(np.uint8)
    best = np.argsort(-count, kind="stable")[:ALPHABET]
    best = best[count[best] > 0]
    table[best] = np.arange(1, len(best) + 1)
    return table[_LOWER]


def grams(text: str, table: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The distinct n-gram ids of text; empty if it has no letter. mark: scratch space of _GRAMS int32."""
    p = _points(text)
    s = np.full(len(p), _RARE, np.int64)
    low = p < 0x10000
    s[low] = table[p[low]]
    if not low.all():
        for i in np.flatnonzero(~low):
            s[i] = _RARE if chr(p[i]).isalpha() else _BLANK
    if not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    two = s[:-1] * _BASE + s[1:]
    ids = np.concatenate([s[s != 0], two + _BASE, two[:-1] * _BASE + s[2:] + _BASE + _BASE**2])
    order = np.arange(len(ids), dtype=np.int32)
    mark[ids] = order
    return ids[mark[ids] == order]


def fit(texts: list[str], langs: list[str], seed: int = 5):
    """(languages, symbol table, columns of the known n-grams or -1, matrix from columns to languages)."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    table, mark = symbol_table(texts), np.zeros(_GRAMS, np.int32)
    pieces, truth = [], []
    for t, lang in zip(texts, langs, strict=True):
        for k in range(PIECES):
            size = len(t) if k == 0 else int(10 ** rng.uniform(0.8, 2.6))
            at = int(rng.integers(0, max(1, len(t) - size)))
            g = grams(t[at : at + size], table, mark)
            if len(g):
                pieces.append(g)
                truth.append(names.index(lang))
    if not pieces:
        return names, table, np.full(_GRAMS, -1, np.int32), np.zeros((0, 0), np.float32)
    truth = np.array(truth)
    rows = np.concatenate([rng.permutation(np.flatnonzero(truth == k))[: LANDMARKS // len(names) + 1] for k in range(len(names))])
    place = np.full(_GRAMS, -1, np.int32)
    known = np.unique(np.concatenate([pieces[i] for i in rows]))
    place[known] = np.arange(len(known))
    present = np.zeros((len(rows), len(known)), np.float32)
    for k, i in enumerate(rows):
        present[k, place[pieces[i]]] = 1 / np.sqrt(len(pieces[i]))
    kernel = np.zeros((len(pieces), len(rows)), np.float64)
    for i, g in enumerate(pieces):
        at = place[g]
        kernel[i] = present[:, at[at >= 0]].sum(axis=1) / np.sqrt(len(g))
    values, vectors = np.linalg.eigh(kernel[rows])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    share = 1 / np.bincount(truth, minlength=len(names))[truth]  # every language counts alike
    goal = np.where(truth[:, None] == np.arange(len(names)), 1.0, -1.0)
    weighted = features * (share * len(share) / len(names))[:, None]
    solved = np.linalg.solve(weighted.T @ features + RIDGE * len(pieces) * np.eye(features.shape[1]), weighted.T @ goal)
    return names, table, place, (present.T @ (root @ solved)).astype(np.float32)


def product(sets: list[np.ndarray], place: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The normed presence rows of n-gram sets times the matrix, in blocks of CELLS numbers."""
    out = np.zeros((len(sets), matrix.shape[1]))
    step = max(1, CELLS // max(1, len(matrix)))
    for k in range(0, len(sets), step):
        part = sets[k : k + step]
        rows = np.zeros((len(part), len(matrix)), np.float32)
        for i, g in enumerate(part):
            at = place[g]
            rows[i, at[at >= 0]] = 1 / np.sqrt(max(len(g), 1))
        out[k : k + step] = rows @ matrix
    return out


def _predict(batches, model):
    import pyarrow as pa

    names, table, place, matrix = model.value
    mark = np.zeros(_GRAMS, np.int32)
    for batch in C.trimmed(batches):
        for part in C.parts(batch, 500_000):
            sets = [grams(t or "", table, mark) for t in part.column("text").to_pylist()]
            scores = product(sets, place, matrix) if matrix.shape[1] else np.zeros((len(sets), 1))
            best = scores.argmax(axis=1)
            spread = np.ptp(scores, axis=1) if scores.shape[1] > 1 else np.ones(len(sets))
            und = (np.array([len(s) for s in sets]) == 0) | (matrix.shape[1] == 0)
            score = np.where(und, 0.0, np.clip((1 + scores.max(axis=1)) / 2, 0, 1))
            lang = ["und" if u else names[b] for u, b in zip(und, best, strict=True)]
            cols = [part.column(c) for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score), pa.array(np.where(und, 0.0, spread))], [*(c for c in part.schema.names if c != "text"), "lang_pred", "score", "spread"])


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(docs: DataFrame):
    """The model from docs(doc_id, text, lang), without the rows that are held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    lot = F.xxhash64("doc_id", F.lit("language"))
    at = F.pmod(lot, F.greatest(F.length("text") - LEARN_CHARS, F.lit(0)) + 1) + 1
    rows = rows.select("doc_id", "lang", F.substring("text", at, F.lit(LEARN_CHARS)).alias("text"), lot.alias("lot"))
    found = C.drawn(rows, PER_LANGUAGE, LANGUAGES).orderBy("lot", "doc_id", "lang").collect()  # LANGUAGES * PER_LANGUAGE stretches
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, held) -> DataFrame:
    """doc_id, lang_pred, score and spread for each row of docs(doc_id, text), by the broadcast model held."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(lambda it: _predict(it, held), "doc_id long, lang_pred string, score double, spread double")


def _shared(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(learn(docs))  # about 2 MB and a float for each known n-gram and language


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang)."""
    told = predict(docs, _shared(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told: not ``und``, and SPREAD between languages."""
    ws = C.Workspace(docs.sparkSession)
    held = _shared(docs)
    told = predict(docs.withColumn("doc_id", C.own_id()), held)
    gone = ws.store(told.filter((F.col("lang_pred") == "und") | (F.col("spread") < SPREAD)).select("doc_id").distinct(), "rejected")
    held.destroy()
    return C.without(docs, gone)
