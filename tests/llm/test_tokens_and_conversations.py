"""Tree concatenation, token alignment and conversation repair against brute force."""

import collections
import hashlib
import itertools
import os
import random
import re

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from test_operators import fixture

from glyphmill.llm import bpe_tree, token_alignment
from glyphmill.llm import conversation_repair as repairs

BITS = ["a", "b", "abc", "'s", "'", "'re", "'ll", "!!", "!'", " ", "  ", "\n", "\t", "   ", "<|endoftext|>", "<|", "endoftext|>", "é", "漢字", "😀", "́", "1", "23", "the ", " the", "aaaa", " " * 9, "　", "x" * 30, "'" * 7, "-" * 11, "\r\n", "▁", "<0x41>", "<s>"]


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(tokenizer, text, special):
    tokenizer.encode_special_tokens = not special
    return tokenizer.encode(text, add_special_tokens=False).ids


def mixture(rng, n):
    pool = rng.sample(BITS, rng.randint(1, 6))
    return "".join(rng.choice(pool) for _ in range(n))


def test_joins_of_parts_are_exact(plain):
    rng, codec = random.Random(5), bpe_tree.codec()
    for _ in range(120):
        text = mixture(rng, rng.randint(0, 90))
        for special in (True, False):
            want = library(plain, text, special)
            for leaf in (1, 7, 40):
                assert codec.encode(text, special, leaf).tolist() == want, (text, leaf)


def test_long_text_without_spaces_is_joined_by_windows(plain):
    codec, windows = bpe_tree.codec(), []
    text = "".join(random.Random(1).choices("etaoinsr", k=200_000))
    once = codec.at_once
    try:
        codec.at_once = lambda t, special=True: windows.append(len(t)) or once(t, special)
        got = codec.encode(text)
    finally:
        codec.at_once = once
    assert got.tolist() == library(plain, text, True)
    assert sum(windows) < 1.1 * len(text) and max(windows) <= bpe_tree.LEAF


def test_encode_and_decode_equal_the_library(spark, plain):
    rng = random.Random(8)
    docs = fixture(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, mixture(rng, 60)) for i in range(60)], "doc_id long, text string"))
    rows = docs.collect()

    def expected(text):
        ids = library(plain, text or "", True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))

    want = sorted((-1 if r.doc_id is None else r.doc_id, *expected(r.text)) for r in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe_tree.digests(docs).collect()) == want
    # parts of long texts as rows of their own
    spread = bpe_tree.encode(docs.withColumnRenamed("doc_id", "ids"), ("ids",), leaf=16, spread=100).collect()
    assert sorted(r.asDict().keys() for r in spread)[0] == {"ids": 0, "ids_": 0}.keys()
    assert sorted((-1 if r.ids is None else r.ids, len(r.ids_)) for r in spread) == [(d, n) for d, n, *_ in want]
    assert bpe_tree.digests(docs.limit(0)).count() == 0


def test_broken_characters_decode_as_in_the_library(plain):
    rng, codec = random.Random(2), bpe_tree.codec()
    for _ in range(200):
        ids = [rng.choice((rng.randrange(256), rng.randrange(50257))) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0] == plain.decode(ids, skip_special_tokens=False)


def alignment(rows, plain):
    """The contract's words in plain Python."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = bpe_tree.codec().table

    def raw(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    counts, found = collections.Counter(), []
    for doc, text in rows:
        a, b = (library(plain, " " + text, False), model.encode(text)) if text else ([], [])
        parts_a, parts_b, whole = [table[i] for i in a], [raw(i) for i in b], (" " + (text or "")).encode()
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            found.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, p))) for p in (parts_a, parts_b))
        links = [(a[i], b[j]) for i, e in enumerate(ends_a) for j in [ends_b.index(e) if e in set(ends_b) else None] if j is not None]
        counts.update(links)
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        text_of = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
        groups = [text_of(a, ends_a, lo, hi) + "|" + text_of(b, ends_b, lo, hi) for lo, hi in itertools.pairwise(cuts)]
        found.append((doc, a, b, links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    told = [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha(g)) for d, a, b, x, g in found]
    return told, counts, [(f[0], f[4]) for f in found]


def test_alignment_equals_brute_force(spark, plain, monkeypatch):
    rng = random.Random(11)
    rows = [(i, mixture(rng, rng.randint(1, 40))) for i in range(150)] + [(200, None), (201, ""), (202, " "), (203, "a "), (204, "  "), (None, "the end."), (205, "x" * 300), (205, "x" * 300), (206, "a ▁ b"), (207, "<|endoftext|> </s>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as n_a").repartition(3)
    want, counts, groups = alignment(rows, plain)
    key = lambda r: (r[0] is not None, r)
    got = [tuple(r) for r in token_alignment.aligned(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[4] for r in got) > 500
    assert {(r.a, r.b): r.total for r in token_alignment.pair_counts(docs).collect()} == counts
    assert sorted(map(tuple, token_alignment.token_groups(docs).collect()), key=key) == sorted(groups, key=key)
    assert token_alignment.aligned(docs.limit(0)).count() == 0
    monkeypatch.setattr(token_alignment, "SLICE", 50)  # on the driver: many slices of few texts
    slices = [s for batch in [docs.toArrow().to_batches()] for b in batch for s in token_alignment._slices([b.select(["doc_id", "text"])], None, None)]
    assert len(slices) > 20 and sum(sum(s.column("n_links")[0].as_py()) for s in slices) == sum(counts.values())


def cheapest(initials, faults):
    """All edits, one by one, with up to two inserts before each row and at the end."""
    found = []

    def walk(i, given, cost, audit):
        if found and cost > min(found)[0]:
            return
        if i == len(initials):
            for more in ("", "a", "u", "ua"):
                if re.fullmatch(r"(s?(ua)+)?", given + more):
                    found.append((cost + 5 * len(more), audit + "I" * len(more)))
            return
        for more in ("", "u", "a", "ua", "au"):
            now, price, told = given + more, cost + 5 * len(more), audit + "I" * len(more)
            if not re.fullmatch(r"(s?(ua)*u?)?", now):
                continue
            walk(i + 1, now, price + 2, told + "D")
            if faults[i] in ".t":
                price += 5 * (faults[i] == "t")
                for role, edit, extra in ((initials[i], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                    if re.fullmatch(r"(s?(ua)*u?)?", now + role):
                        walk(i + 1, now + role, price + extra, told + edit)

    walk(0, "", 0, "")
    return min(found)


def test_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 5)
        initials, faults = "".join(rng.choices("uasx ", (4, 4, 2, 1, 1), k=n)), "".join(rng.choices(".btd", (6, 1, 2, 1), k=n))
        assert min(repairs.search(initials, faults).values()) == cheapest(initials, faults), (initials, faults)


CONVERSATIONS = "conv_id long, turn long, role string, text string, bucket int"


def conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randint(1, 9) if c else 400
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(("user", "assistant")) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            rows.append((c, t * rng.choice((1, 1, 2)) - 3, role, f"{'ab' * (t % 40)} {rng.randint(0, 20)} é{rng.choice('.!? ,')}{rng.choice((' ', '', chr(10)))}", 7))
    rows += [(70, None, "user", "Hi.", 0), (70, None, None, None, 0), (70, 5, "assistant", None, 0), (None, 1, "user", "?", 0), (None, 2, "tool", "x.", 0), (71, 3, "user", "twice.", 0), (71, 3, "user", "twice.", 0), (71, 4, "", "y.", 0), (72, 9, "unknown", "z!" * 5000, 0)]
    rows += [(80 + i, 0, "user", " \t", 0) for i in range(20)]
    return spark.createDataFrame(rows, CONVERSATIONS)


def test_repair_equals_sql_in_one_piece_or_many(spark):
    frame = conversations(spark)
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    key = lambda r: (r[0] is not None, r)
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(names)} from ({repairs.ORACLE})").fetchall()), key=key)
    got = repairs.repair(frame)
    assert got.columns == names and sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sorted((tuple(r) for r in repairs.repair(frame, span=2, limit=3).collect()), key=key) == want
    empty = [r for r in want if r[7] == ""]
    assert empty and all(r[8] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert repairs.repair(frame.limit(0)).count() == 0
