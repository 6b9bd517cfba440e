"""Repair of damaged conversations by the cheapest edits that make their roles alternate.

A conversation's rows, in order of turn, and the roles that the edits have given so far span a lattice of (row, state);
keep, rerole, delete and insert are its steps. A* searches it, keyed by (cost plus heuristic, audit), where the
heuristic is the suffix sum of mandatory deletions (blank and duplicate rows) and of the least that a truncated row
costs, its deletion. Each step costs at least what it takes off the heuristic, so the first time a state is popped is
its cheapest and, of equal ones, its ASCII-least audit.

Rows meet by conversation and by SPAN of turns, in pieces of at most LIMIT rows, so that a conversation with a third of
all rows is spread over many tasks. A conversation of one piece is done there. Of one with more pieces, A* gives for
each piece the cheapest edits from every state before it to every state after it; these are chained in order, and rows
seen in an earlier piece are found by a join. One task reads a conversation's repaired text in order for its hash, in
pieces.

Nulls: a null role or text is one space, and so is a null conv_id or turn in the hash that damages; null turns come
first and a null conv_id is a conversation. Ties: rows of one turn are in order of role and text, a repeated row after
its like. Repeated rows are duplicates. An empty role's initial is a space. A text of any length is whole. Empty tables
give empty results; extra columns are ignored. A conversation all of whose rows are gone has zeros.
"""

from __future__ import annotations

import hashlib
import heapq
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Turns of a span, as a power of two, and the most rows of a piece.
SPAN, LIMIT = 9, 512
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What an undeleted truncated row adds.
CUT = 5
#: States: nothing yet, after the system row, after a user's row, after an assistant's. (state, initial) -> state.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role that a state's next row may be given.
NEXT, DONE = {0: "user", 1: "user", 2: "assistant", 3: "user"}, (0, 3)

_PIECE = (
    "conv_id {id}, bucket long, piece int, turns long, low long, high long, initials string, faults string, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string, digests array<binary>, roles array<string>, texts array<string>"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of every row that the damage by crc32('conv_id:turn') % 20 leaves."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(name), F.lit(20)).alias("fate"))
    hit = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), hit.alias("text"), F.explode(copies).alias("copy"))


def search(initials: str, faults: str, start: int = 0, goals: tuple[int, ...] = DONE, every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from start to the goals: the best goal alone, or each of them.

    faults has b, d, t or . for each row.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0 if faults[i] == "." else DELETE)  # of a truncated row: the less of DELETE and CUT
    heap, done, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        f, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        g = f - ahead[i]
        if i == n and q in goals:
            found[q] = (g, audit)
            if not every or len(found) == len(goals):
                break
        given = STEP[q, NEXT[q][0]]
        if i < n:
            rest = g + ahead[i + 1]
            heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, q))
            if faults[i] in ".t":
                rest += CUT * (faults[i] == "t")
                kept = STEP.get((q, initials[i]))
                if kept is not None:
                    heapq.heappush(heap, (rest + KEEP, audit + "K", i + 1, kept))
                if kept != given:
                    heapq.heappush(heap, (rest + REROLE, audit + "R", i + 1, given))
        if (i, given) not in done:
            heapq.heappush(heap, (f + INSERT, audit + "I", i, given))
    return found


def rebuilt(roles: list[str], texts: list[str], audit: str, state: int = 0) -> list[str]:
    """The lines role:text that the edits leave."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = STEP[state, roles[i][:1]]
        elif edit != "D":
            out.append(f"{NEXT[state]}:{texts[i] if edit == 'R' else ''}")
            state = STEP[state, NEXT[state][0]]
        i += edit != "I"
    return out


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _piece(conv, bucket, piece, rows, turns):
    """A row of _PIECE; rows have (turn, role, text, blank, last letter)."""
    seen, faults, digests = set(), [], []
    for _, role, text, blank, last in rows:
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()
        fault = "b" if blank else "d" if key in seen else "." if last in ".!?" else "t"
        seen.add(key)
        faults.append(fault)
        digests.append(key if fault in ".t" else None)
    roles, texts = [r[1] for r in rows], [r[2] for r in rows]
    initials, faults = "".join(r[:1] or " " for r in roles), "".join(faults)
    cost, audit = min(search(initials, faults).values())
    known = [r[0] for r in rows if r[0] is not None]
    sha = hashlib.sha256("\n".join(rebuilt(roles, texts, audit)).encode()).hexdigest()
    counts = (faults.count("b"), faults.count("d"), faults.count("t"), _illegal(initials))
    return (conv, bucket, piece, turns, min(known, default=None), max(known, default=None), initials, faults, *counts, cost, audit, sha, digests, roles, texts)


def _pieces(batches, kind, limit):
    """Sorted rows cut into pieces as they come; a piece ends with its conversation, its span of turns, or at limit rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    at, piece, rows, turns, last_turn = None, 0, [], 0, None
    for batch in C.trimmed(batches):
        out = []
        for conv, bucket, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "bucket", "turn", "role", "text", "blank", "last")), strict=True):
            if rows and (at != (conv, bucket) or len(rows) == limit):
                out.append(_piece(*at, piece, rows, turns))
                rows, turns, piece = [], 0, piece + 1
            if at != (conv, bucket):
                at, piece, last_turn = (conv, bucket), 0, None
            turns += row[0] is not None and row[0] != last_turn
            last_turn = row[0]
            rows.append(row)
        if out:
            yield made(out)
    if rows:
        yield made([_piece(*at, piece, rows, turns)])


def _matrices(batches):
    """For each piece its counts and, from each state before it to each after it, the cheapest edits."""
    import pyarrow as pa

    for batch in C.trimmed(batches):
        cols = {n: [] for n in ("faults", "blank", "duplicate", "truncated", "entry", "exit", "cost", "audit")}
        for initials, faults, late, no, of in zip(*(batch.column(n).to_pylist() for n in ("initials", "faults", "late", "no", "of")), strict=True):
            now = list(faults)
            for k in late or ():
                now[k] = "d"
            faults = "".join(now)
            cells = [(q, e, *best) for q in ((0,) if no == 1 else range(4)) for e, best in search(initials, faults, q, DONE if no == of else (0, 1, 2, 3), True).items()]
            for name, value in zip(cols, (faults, faults.count("b"), faults.count("d"), faults.count("t"), *map(list, zip(*cells, strict=True))), strict=True):
                cols[name].append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        kept = ("conv_id", "bucket", "piece", "no", "of", "initials")
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True))], [*kept, *cols])


def _chain(batches, kind):
    """The cheapest way through each conversation's pieces: a row for each piece with its edits, counts on the first.

    Ways of equal cost are compared by what follows the part that all of them share.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    ways: dict = {}
    for batch in C.trimmed(batches):
        out = []
        for row in batch.to_pylist():
            if row["no"] == 1:
                ways, sums, last = {0: (0, "", None)}, [0] * 4, ""
            new: dict = {}
            for q, e, cost, audit in zip(row["entry"], row["exit"], row["cost"], row["audit"], strict=True):
                if q in ways:
                    before, tail, link = ways[q]
                    way = (before + cost, tail + audit, (link, row["bucket"], row["piece"], row["no"], q, audit))
                    if e not in new or way[:2] < new[e][:2]:
                        new[e] = way
            shared = len(os.path.commonprefix([w[1] for w in new.values()]))
            ways = {e: (cost, tail[shared:], link) for e, (cost, tail, link) in new.items()}
            sums = [a + b for a, b in zip(sums, (row["blank"], row["duplicate"], row["truncated"], _illegal(last + row["initials"])), strict=True)]
            last = row["initials"][-1:]
            if row["no"] == row["of"]:
                cost, _, link = min((w for e, w in ways.items() if e in DONE), key=lambda w: w[:2])
                while link:
                    link, bucket, piece, no, q, audit = link
                    out.append((row["conv_id"], bucket, piece, no, q, audit, *((*sums, cost) if no == 1 else (None,) * 5)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _lines(batches):
    import pyarrow as pa

    for batch in C.trimmed(batches):
        parts = ["\n".join(rebuilt(*r)) for r in zip(*(batch.column(n).to_pylist() for n in ("roles", "texts", "audit", "entry")), strict=True)]
        some = [any(e != "D" for e in a) for a in batch.column("audit").to_pylist()]
        kept = ("conv_id", "no", "audit")
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(parts, pa.string()), pa.array(some)], [*kept, "lines", "some"])


def _hashes(batches):
    """The hash and the audit of each conversation from its sorted pieces, read once, in order."""
    import pyarrow as pa

    conv, sha, audits, any_yet, began = None, None, [], False, False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(audits)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    for batch in C.trimmed(batches):
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if row["no"] == 1:
                if began:
                    yield done()
                conv, sha, audits, any_yet, began = row["conv_id"], hashlib.sha256(), [], False, True
            audits.append(row["audit"])
            if row["some"]:
                sha.update((("\n" if any_yet else "") + row["lines"]).encode())
                any_yet = True
    if began:
        yield done()


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a joined to b on names, a null equal to a null; the columns of a, then the others of b."""
    b = b.select(*(F.col(n).alias(f"_{n}" if n in names else n) for n in b.columns))
    on = [F.col(n).eqNullSafe(F.col(f"_{n}")) if n == "conv_id" else F.col(n) == F.col(f"_{n}") for n in names]
    return a.join(b, on, how).drop(*(f"_{n}" for n in names))


def repair(conversations: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """For every conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of rows(conv_id, turn, role, text, copy).

    The rows of conversations are damaged first; see damaged.
    """
    return _repaired(damaged(conversations), conversations.select("conv_id").distinct(), span, limit)


def _repaired(rows: DataFrame, originals: DataFrame, span: int, limit: int) -> DataFrame:
    ws = C.Workspace(rows.sparkSession)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    bucket = F.coalesce(F.shiftright("turn", span), F.lit(-(2**63)))  # a smaller number than any turn's
    rows = rows.select("conv_id", bucket.alias("bucket"), "turn", "role", "text", "copy", (last == "").alias("blank"), last.alias("last"))
    order = ("conv_id", "bucket", "turn", "role", "text", "copy")
    id_kind = rows.schema["conv_id"].dataType.simpleString()
    kind = rows.sparkSession.createDataFrame([], _PIECE.format(id=id_kind)).schema
    pieces = ws.store(rows.repartition("conv_id", "bucket").sortWithinPartitions(*order).mapInArrow(lambda it: _pieces(it, kind, limit), kind), "pieces")

    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    facts = ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    # of a conversation with one piece, the least of a fact is that fact
    per = ws.store(pieces.groupBy("conv_id").agg(F.count("*").alias("of"), gaps, *(F.min(c).alias(c) for c in facts)), "conversations")
    told = per.filter("of = 1").drop("of")
    many = per.filter("of > 1").select("conv_id")
    n_many = many.count()
    if n_many:
        told = told.unionByName(_same(_of_pieces(ws, _same(pieces, C.by_size(many, n_many), ("conv_id",)), id_kind), per.select("conv_id", "gaps"), ("conv_id",)))
    zeros = {c: F.lit("") if c == "audit" else F.sha2(F.lit(""), 256) if c == "repaired_sha256" else F.lit(0).cast("long") for c in ("gaps", *facts)}
    return _same(originals, told, ("conv_id",), "left").select("conv_id", *(F.coalesce(c, z).alias(c) for c, z in zeros.items()))


def _of_pieces(ws: C.Workspace, pieces: DataFrame, id_kind: str) -> DataFrame:
    """The facts of conversations with more than one piece."""
    name = ("conv_id", "bucket", "piece")
    by = Window.partitionBy("conv_id")
    numbered = pieces.select(*name).withColumns({"no": F.row_number().over(by.orderBy("bucket", "piece")), "of": F.count("*").over(by).cast("int")})
    each = pieces.select(*name, F.posexplode("digests").alias("pos", "digest")).filter("digest is not null")
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("bucket", "piece", "pos")).alias("at")).select("conv_id", "digest", "at.*")
    late = _same(each, first, (*name, "digest", "pos"), "left_anti").groupBy(*name).agg(F.collect_list("pos").alias("late"))  # at most LIMIT
    todo = _same(_same(pieces.select(*name, "initials", "faults"), numbered, name), late, name, "left")
    cells = "faults string, blank long, duplicate long, truncated long, entry array<int>, exit array<int>, cost array<long>, audit array<string>"
    matrices = todo.mapInArrow(_matrices, f"conv_id {id_kind}, bucket long, piece int, no int, of int, initials string, {cells}")
    kind = ws.spark.createDataFrame([], f"conv_id {id_kind}, bucket long, piece int, no int, entry int, audit string, blank long, duplicate long, truncated long, illegal long, cost long").schema
    chosen = ws.store(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(lambda it: _chain(it, kind), kind), "chosen")
    texts = _same(chosen.select(*name, "no", "entry", "audit"), pieces.select(*name, "roles", "texts"), name)
    lines = texts.mapInArrow(_lines, f"conv_id {id_kind}, no int, audit string, lines string, some boolean")
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(_hashes, f"conv_id {id_kind}, audit string, repaired_sha256 string")
    return _same(chosen.filter("no = 1").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost"), hashed, ("conv_id",))


ORACLE = r"""
with recursive fated as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda e, _: case when e & 1 = 1 then xor(e >> 1, 3988292384) else e >> 1 end)), 4294967295) % 20 as fate
  from conversations
), hurt as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when fate = 3 then [0, 1] else [0] end) as copy
  from fated where fate <> 0
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last_char
  from hurt
), faulty as (
  select conv_id, turn, role, text, k, case when role = '' then ' ' else role[1] end as initial,
    case when last_char = '' then 'b' when seen > 1 then 'd' when last_char in ('.', '!', '?') then '.' else 't' end as fault
  from ordered
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    max(k) as n, list(initial order by k) as i, list(fault order by k) as f, list(role order by k) as r, list(text order by k) as x
  from faulty group by conv_id
), walk as (
  -- s0 to s3: {cost, audit, lines} of the cheapest edits into each state before row k + 1, inserts after row k included
  select conv_id, 0 as k, {'c': 0, 'a': '', 'l': []::varchar[]} as s0, {'c': 9999999, 'a': '', 'l': []::varchar[]} as s1,
    {'c': 5, 'a': 'I', 'l': ['user:']} as s2, {'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']} as s3
  from counted
  union all
  select conv_id, k, s0, s1,
    list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I', 'l': s0.l || ['user:']}, {'c': s1.c + 5, 'a': s1.a || 'I', 'l': s1.l || ['user:']}, {'c': s3.c + 5, 'a': s3.a || 'I', 'l': s3.l || ['user:']}]),
    list_min([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'l': s2.l || ['assistant:']},
      {'c': s0.c + 10, 'a': s0.a || 'II', 'l': s0.l || ['user:', 'assistant:']}, {'c': s1.c + 10, 'a': s1.a || 'II', 'l': s1.l || ['user:', 'assistant:']}])
  from (
    select conv_id, k, {'c': s0.c + 2, 'a': s0.a || 'D', 'l': s0.l} as s0,
      list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 'l': s1.l}] || case when live and ini = 's' then [{'c': s0.c + pen, 'a': s0.a || 'K', 'l': s0.l || [line]}] else [] end) as s1,
      list_min([{'c': s2.c + 2, 'a': s2.a || 'D', 'l': s2.l}] || case when not live then [] when ini = 'u' then
        [{'c': s0.c + pen, 'a': s0.a || 'K', 'l': s0.l || [line]}, {'c': s1.c + pen, 'a': s1.a || 'K', 'l': s1.l || [line]}, {'c': s3.c + pen, 'a': s3.a || 'K', 'l': s3.l || [line]}] else
        [{'c': s0.c + pen + 1, 'a': s0.a || 'R', 'l': s0.l || [as_user]}, {'c': s1.c + pen + 1, 'a': s1.a || 'R', 'l': s1.l || [as_user]}, {'c': s3.c + pen + 1, 'a': s3.a || 'R', 'l': s3.l || [as_user]}] end) as s2,
      list_min([{'c': s3.c + 2, 'a': s3.a || 'D', 'l': s3.l}] || case when not live then [] when ini = 'a' then [{'c': s2.c + pen, 'a': s2.a || 'K', 'l': s2.l || [line]}]
        else [{'c': s2.c + pen + 1, 'a': s2.a || 'R', 'l': s2.l || [as_assistant]}] end) as s3
    from (
      select w.conv_id, w.k + 1 as k, s0, s1, s2, s3, i[w.k + 1] as ini, f[w.k + 1] in ('.', 't') as live, case when f[w.k + 1] = 't' then 5 else 0 end as pen,
        r[w.k + 1] || ':' || x[w.k + 1] as line, 'user:' || x[w.k + 1] as as_user, 'assistant:' || x[w.k + 1] as as_assistant
      from walk w join counted c on w.conv_id is not distinct from c.conv_id where w.k < c.n
    )
  )
), ended as (
  select c.*, list_min([s0, s3]) as best from walk w join counted c on w.conv_id is not distinct from c.conv_id and w.k = c.n
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(len(list_filter(range(1, n), lambda j: i[j] || i[j + 1] not in ('su', 'ua', 'au'))), 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join ended e on o.conv_id is not distinct from e.conv_id
"""
