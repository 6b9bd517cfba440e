"""Queries of folds, box matching, box transfer and fitted costs: line items play pieces, words, boxes and witnesses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.functions.shipping import spread, stored
from glyphmill.operators import boxes as B
from glyphmill.operators import comparison as M
from glyphmill.operators import consensus as V
from glyphmill.operators import folds as L
from glyphmill.operators import shapes as H
from glyphmill.operators import sheets as T
from glyphmill.operators import spatial as G

# an order is a sheet of one leaf, its line items the pieces from the spine outward: as wide as the quantity, folded by
# the flag, as high as tax and discount say; a face's page goes by the part, and its own name has the piece's number
PIECES_SQL = """li{t} as (select l_orderkey as sheet, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as j,
  l_quantity as width, {way} as way, l_tax * 100 as low, l_tax * 100 + 2 + l_discount * 100 as high,
  'p' || l_partkey % 3 || 'r' as front_page, 'p' || l_suppkey % 3 || 'v' as back_page from lineitem),
faces{t} as (select *, front_page || ' (' || j || ')' as front, back_page || ' (' || j || ')' as back from li{t}),
stacks{t}(sheet, j, stack) as (
  select sheet, 0, [0] from li{t} where j = 0
  union all
  select s.sheet, s.j + 1, case when l.way * (case when s.j % 2 = 0 then 1 else -1 end) > 0 then stack[:list_position(stack, s.j)] || [s.j + 1] || stack[list_position(stack, s.j) + 1:]
    else stack[:list_position(stack, s.j) - 1] || [s.j + 1] || stack[list_position(stack, s.j):] end
  from stacks{t} s join li{t} l on l.sheet = s.sheet and l.j = s.j + 1),
whole{t} as (select sheet, arg_max(stack, j) as stack from stacks{t} group by sheet),
edges{t} as (select *, sum(case when j % 2 = 0 then width else -width end) over (partition by sheet order by j) as e from faces{t}),
lain{t} as (select sheet, j, width, way, low, high, front, back, front_page, back_page, list_position(stack, j) - list_position(stack, 0) as layer, j % 2 = 0 as up,
  least(e, e - case when j % 2 = 0 then width else -width end) as x0, greatest(e, e - case when j % 2 = 0 then width else -width end) as x1 from edges{t} join whole{t} using (sheet)),
met{t} as (select a.sheet, a.j as a, case when a.up then 1 else -1 end as a_face, case when a.up then a.front else a.back end as a_name,
  arg_min(b.j, b.layer) as b, arg_min(case when b.up then -1 else 1 end, b.layer) as b_face, arg_min(case when b.up then b.back else b.front end, b.layer) as b_name
  from lain{t} a join lain{t} b on a.sheet = b.sheet and b.layer > a.layer and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 and least(a.high, b.high) - greatest(a.low, b.low) > 1 group by all)"""
# finished orders are recorded whole, open ones by two pairs: pages, and the first piece's inside with the third's outside
TOUCH_SQL = """rec{t} as (select o_orderkey as sheet, o_orderstatus = 'F' as every from orders where o_orderstatus in ('F', 'O')),
touch{t} as (select sheet, 0 as t, 'p0r' as a, 'p1r' as b from rec{t} where not every
  union all select r.sheet, 1, f.front, g.back from rec{t} r join faces{t} f on f.sheet = r.sheet and f.j = 0 join faces{t} g on g.sheet = r.sheet and g.j = 2 where not every),
sides{t} as (select sheet, 2 * j as place, j, 1 as face, front as own, front_page as page, layer, up, x0, x1, low, high from lain{t}
  union all select sheet, 2 * j + 1, j, -1, back, back_page, layer, up, x0, x1, low, high from lain{t}),
named{t} as (select n.sheet, n.name, s.* exclude (sheet) from (select distinct sheet, a as name from touch{t} union select sheet, b from touch{t}) n join sides{t} s on s.sheet = n.sheet and (s.own = n.name or s.page = n.name)
  qualify (s.own = n.name) = bool_or(s.own = n.name) over (partition by n.sheet, n.name)),
tried{t} as (select t.sheet, t.t, t.a, t.b, x.j as xj, x.face as xf, x.place as xp, y.j as yj, y.face as yf, y.place as yp, abs(x.layer - y.layer) as d,
  x.j <> y.j and least(x.x1, y.x1) - greatest(x.x0, y.x0) > 1 and least(x.high, y.high) - greatest(x.low, y.low) > 1
  and case when x.layer < y.layer then ((x.face = 1) = x.up) and not ((y.face = 1) = y.up) else ((y.face = 1) = y.up) and not ((x.face = 1) = x.up) end as fit
  from touch{t} t join named{t} x on x.sheet = t.sheet and x.name = t.a join named{t} y on y.sheet = t.sheet and y.name = t.b),
seen{t} as (select sheet, xj as a, xf as a_face, a as a_name, yj as b, yf as b_face, b as b_name from tried{t}
  qualify row_number() over (partition by sheet, t order by not fit, case when fit then d else 0 end, xp, yp) = 1),
told{t} as (select sheet, a, a_face, a_name, b, b_face, b_name, 'confirmed' as fold from seen{t}
  union all select m.*, case when r.every then 'confirmed' else 'inferred' end from met{t} m left join rec{t} r using (sheet)
  where not exists (select 1 from seen{t} s where s.sheet = m.sheet and ((s.a, s.a_face, s.b, s.b_face) = (m.a, m.a_face, m.b, m.b_face) or (s.b, s.b_face, s.a, s.a_face) = (m.a, m.a_face, m.b, m.b_face))))"""


def _contacts_sql(t: str = "", way: str = "case when l_returnflag = 'R' then -1 else 1 end", touched: bool = False) -> str:
    """The steps from line items to contacts, their names ending in t."""
    return (PIECES_SQL + (",\n" + TOUCH_SQL if touched else "")).format(t=t, way=way)


def _leaves(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    page = lambda key, side: F.concat(F.lit("p"), F.col(key) % 3, F.lit(side))
    low = F.col("l_tax") * 100
    told = li.withColumn("j", j).withColumn("fp", page("l_partkey", "r")).withColumn("bp", page("l_suppkey", "v"))
    name = lambda c: F.concat(c, F.lit(" ("), F.col("j"), F.lit(")"))
    own = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    piece = F.struct("j", F.col("l_quantity").alias("width"), own.alias("way"), low.alias("low"), (low + 2 + F.col("l_discount") * 100).alias("high"), name("fp").alias("front"), name("bp").alias("back"), F.col("fp").alias("front_page"), F.col("bp").alias("back_page"))
    return told.groupBy(F.col("l_orderkey").alias("sheet")).agg(F.array_sort(F.collect_list(piece)).alias("pieces")).withColumn("leaf", F.lit(0))


def _touches(spark, sf_dir, leaves):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("sheet"), (F.col("o_orderstatus") == "F").alias("every"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    third = F.filter(F.array(pair(F.get("pieces", F.lit(0))["front"], F.get("pieces", F.lit(2))["back"])), lambda x: x["b"].isNotNull())
    return orders.join(leaves.select("sheet", F.concat(F.array(pair(F.lit("p0r"), F.lit("p1r"))), third).alias("touch")), "sheet")


@query(f"with recursive {_contacts_sql()} select sheet, j as piece, cast(layer as int) as layer, up, cast(x0 as double) as x0, cast(x1 as double) as x1 from lain")
def fold_stacks(spark, sf_dir):
    return L.stacked(_leaves(spark, sf_dir)).select("sheet", F.explode("pieces").alias("p")).select("sheet", "p.piece", "p.layer", "p.up", "p.x0", "p.x1")


@query(f"with recursive {_contacts_sql(touched=True)} select sheet, a, a_face, a_name, b, b_face, b_name, fold from told")
def sheet_contacts(spark, sf_dir):
    leaves = stored(_leaves(spark, sf_dir), "leaves")
    return L.sheet_contacts(L.stacked(leaves), _touches(spark, sf_dir, leaves)).drop("leaf")


# a customer's orders by date make an order of leaves, by key its base, where all folds go in
@query(f"""with recursive {_contacts_sql("", touched=True)}, {_contacts_sql("_b", "1", touched=True)},
numbered as (select o_custkey as order_id, o_orderkey as sheet, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, row_number() over (partition by o_custkey order by o_orderkey) as m from orders),
own as (select order_id, n, m, f.back || '/' || p.sheet as name from numbered p join faces f on f.sheet = p.sheet and f.j = 0),
was as (select a.order_id, least(a.name, b.name) as low, greatest(a.name, b.name) as high from own a join own b on a.order_id = b.order_id and b.m = a.m + 1),
base as (select distinct sheet, least(a_name, b_name) as low, greatest(a_name, b_name) as high from told_b)
select a.order_id, cast(a.n as double) as pos, 'facing' as kind, cast(null as varchar) as fold, a.name as a_name, b.name as b_name,
  not exists (select 1 from was w where w.order_id = a.order_id and w.low = least(a.name, b.name) and w.high = greatest(a.name, b.name)) as is_new
from own a join own b on a.order_id = b.order_id and b.n = a.n + 1
union all
select n.order_id, n.n + 0.5, 'fold', fold, a_name, b_name, not exists (select 1 from base b where b.sheet = t.sheet and b.low = least(a_name, b_name) and b.high = greatest(a_name, b_name))
from told t join numbered n using (sheet)""")
def order_contacts(spark, sf_dir):
    folded = stored(_leaves(spark, sf_dir), "leaves")
    base = folded.withColumn("pieces", F.transform("pieces", lambda p: p.withField("way", F.lit(1))))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("order_id"), F.col("o_orderkey").alias("sheet"), "o_orderdate")
    first = folded.select("sheet", F.concat(F.col("pieces")[0]["back"], F.lit("/"), "sheet").alias("name"))

    def facing(*by):
        w = Window.partitionBy("order_id").orderBy(*by)
        named = orders.withColumn("pos", F.row_number().over(w)).join(first, "sheet")  # places count orders without pieces too
        nxt = named.select("order_id", (F.col("pos") - 1).alias("pos"), F.col("name").alias("b_name"))
        return named.select("order_id", "pos", F.col("name").alias("a_name")).join(nxt, ["order_id", "pos"])

    leaves = orders.withColumn("n", F.row_number().over(Window.partitionBy("order_id").orderBy("o_orderdate", "sheet"))).select("order_id", "sheet", F.lit(0).alias("leaf"), "n")
    touches = _touches(spark, sf_dir, folded)
    inside = [L.sheet_contacts(L.stacked(x), touches) for x in (folded, base)]
    return L.contacts_in_order(facing("o_orderdate", "sheet"), facing("sheet"), *inside, leaves)


# a customer is a page, its orders are lines, their items words of twenty letters. Boxes are listed line by line in another
# order. A second or fourth word may be split in two boxes, have a box that reads otherwise, or none; a third word may be a
# letter off; every seventh line jumps after its fourth word; every eleventh has no boxes; some last words read alike on the
# page, others are listed at the page's end and a letter off. What the matching has to find follows from these rules.
WORDS_SQL = """told as (select o_custkey as page, l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
  count(*) over (partition by l_orderkey) as n from lineitem join orders on o_orderkey = l_orderkey),
kinds as (select *, line % 7 = 1 as jump, line % 11 = 0 as dropped,
  case when line % 7 <> 1 and pos in (2, 4) then case (line * 3 + pos) % 6 when 0 then 'split' when 1 then 'gone' when 2 then 'absent' else 'plain' end else 'plain' end as odd,
  case when line % 7 <> 1 then (line * 3 + 2) % 6 > 2 else true end as second_plain from told),
marked as (select *, odd = 'plain' and pos = n and n in (2, 4, 6) and line % 5 = 2 and not jump as common, pos = n and n in (3, 5) and line % 5 = 3 and not jump as moved from kinds),
words as (select *, case when common then 'alikeonthewholepages' else translate(substring(md5(line || ':' || pos), 1, 20), '0123456789', 'ghijklmnop') end as text,
  moved or (pos = 3 and second_plain and line % 4 = 0) as off from marked),
listed as (select page, line, pos, 0 as part, case when moved then 2 else 0 end as place from words where not dropped and odd <> 'absent'
  union all select page, line, pos, 1, 0 from words where not dropped and odd = 'split'
  union all select page, line, 99, 0, 0 from words where not dropped and pos = 1 and line % 3 = 0
  union all select page, 0, k, 0, 1 from (select distinct page from words), (select unnest(range(6)) as k)),
numbered as (select *, row_number() over (partition by page order by place, md5(cast(line as varchar)), line, pos, part) as box from listed),
placed as (select w.*, case
    when dropped or odd = 'absent' then null
    when odd in ('split', 'gone') then case when pos < n and not (n = pos + 1 and n in (3, 5) and line % 5 = 3) then 'between' end
    when moved then 'one'
    when jump and pos = 5 and n = 5 then null
    else 'run' end as how from words w)"""


def _joined(name):
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)


def _letters(*parts):
    return F.translate(F.substring(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).cast("binary")), 1, 20), "0123456789", "ghijklmnop")


def _page_words(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    by = Window.partitionBy("l_orderkey")
    told = li.select(F.col("o_custkey").alias("page"), F.col("l_orderkey").alias("line"), F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("pos"), F.count("*").over(by).alias("n"))
    line, pos, n, jump = F.col("line"), F.col("pos"), F.col("n"), F.col("line") % 7 == 1
    rest = (line * 3 + pos) % 6
    odd = F.when(~jump & pos.isin(2, 4), F.when(rest == 0, "split").when(rest == 1, "gone").when(rest == 2, "absent").otherwise("plain")).otherwise("plain")
    told = told.withColumns({"jump": jump, "dropped": line % 11 == 0, "odd": odd})
    told = told.withColumn("common", (F.col("odd") == "plain") & (pos == n) & n.isin(2, 4, 6) & (line % 5 == 2) & ~jump)
    told = told.withColumn("moved", (pos == n) & n.isin(3, 5) & (line % 5 == 3) & ~jump)
    off = F.col("moved") | ((pos == 3) & (jump | ((line * 3 + 2) % 6 > 2)) & (line % 4 == 0))
    return told.withColumns({"text": F.when(F.col("common"), "alikeonthewholepages").otherwise(_letters("line", "pos")), "off": off})


def _page_boxes(words):
    """The boxes as listed: where a word's box is drawn follows from its line's place on the page and its own on the line."""
    up = words.withColumn("row", F.dense_rank().over(Window.partitionBy("page").orderBy("line"))).filter("not dropped")
    x = 60.0 * F.col("pos") + F.when(F.col("jump") & (F.col("pos") >= 5), 3000).otherwise(0)
    text = F.when(F.col("odd") == "gone", _letters("line", "pos", F.lit("gone"))).when(F.col("off"), F.concat(F.lit("z"), F.substring("text", 2, 19))).otherwise(F.col("text"))
    half = lambda k: F.struct(F.lit(k).alias("part"), F.substring("text", 1 + 10 * k, 10).alias("text"), (x - 15 + 30 * k).alias("x"))
    parts = F.when(F.col("odd") == "split", F.array(half(0), half(1))).otherwise(F.array(F.struct(F.lit(0).alias("part"), text.alias("text"), x.alias("x"))))
    y = 100.0 * F.col("row")
    own = up.filter("odd <> 'absent'").select("page", "line", "pos", F.when(F.col("moved"), 2).otherwise(0).alias("place"), y.alias("y"), F.explode(parts).alias("b")).select("page", "line", "pos", "b.part", "place", "b.text", "b.x", "y")
    stray = up.filter("pos = 1 and line % 3 = 0").select("page", "line", F.lit(99).alias("pos"), F.lit(0).alias("part"), F.lit(0).alias("place"), _letters("line", F.lit("stray")).alias("text"), F.lit(2000.0).alias("x"), y.alias("y"))
    apart = words.select("page").distinct().select("page", F.lit(0).cast("long").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"), F.lit(0).alias("part"), F.lit(1).alias("place"))
    apart = apart.select("*", _letters("page", "pos", F.lit("apart")).alias("text"), F.lit(-5000.0).alias("x"), F.lit(0.0).alias("y"))
    listed = own.unionByName(stray).unionByName(apart)
    box = F.row_number().over(Window.partitionBy("page").orderBy("place", F.md5(F.col("line").cast("string").cast("binary")), "line", "pos", "part"))
    return listed.select("page", box.alias("box"), "text", "x", "y", F.lit(20.0).alias("h"))


@query(f"""with {WORDS_SQL} select p.page, p.line, cast(p.pos as int) as pos, string_agg(cast(box as varchar), ' ' order by part) as boxes, how
from placed p join numbered b on b.page = p.page and b.line = p.line and b.pos = p.pos and b.place <> 1 where how is not null group by all""")
def boxes_matched(spark, sf_dir):
    words = stored(_page_words(spark, sf_dir), "words")  # read several times
    told = B.match_boxes(words.select("page", "line", "pos", "text", (F.col("n") == 1).alias("label")), _page_boxes(words))
    return told.select("page", "line", "pos", _joined("boxes"), "how")


# three words of five letters, and their letters cut into three to five boxes at even places, some letters changed
@query("""with told as (select l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos from lineitem),
w as (select line, list(translate(substring(md5(line || ':' || pos), 1, 5), '0123456789', 'ghijklmnop') order by pos) as words, 3 + line % 3 as m from told where pos <= 3 group by line having count(*) = 3),
f as (select *, translate(words[1] || words[2] || words[3], 'gk', 'zz') as flat from w),
b as (select line, words, m, list_transform(range(m), lambda i: substring(flat, cast(i * 15 // m as bigint) + 1, cast((i + 1) * 15 // m - i * 15 // m as bigint))) as boxes from f),
cuts as (select line, words, boxes, m, c, d from b, (select unnest(range(1, 4)) as c), (select unnest(range(2, 5)) as d) where c < d and d < m),
cost as (select line, [c, d - c, m - d] as sizes, c, d, levenshtein(words[1], list_aggregate(boxes[1:c], 'string_agg', '')) + levenshtein(words[2], list_aggregate(boxes[c + 1:d], 'string_agg', '')) + levenshtein(words[3], list_aggregate(boxes[d + 1:], 'string_agg', '')) as far from cuts)
select line, list_aggregate(list_transform(arg_min(sizes, (far, d, c)), lambda x: cast(x as varchar)), 'string_agg', ' ') as sizes from cost group by line""")
def boxes_shared(spark, sf_dir):
    words = _page_words(spark, sf_dir).filter("pos <= 3").withColumn("five", F.substring(_letters("line", "pos"), 1, 5))
    rows = words.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "five"))), lambda x: x["five"]).alias("words")).filter("size(words) = 3")
    m, flat = 3 + F.col("line") % 3, F.translate(F.array_join("words", ""), "gk", "zz")
    at = lambda i: F.floor(i * 15 / m).cast("int")
    boxes = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.substring(flat, at(i) + 1, at(i + 1) - at(i)))
    return B.boxes_shared_out(rows.withColumn("boxes", boxes)).select("line", _joined("sizes"))


# an order is a line, an item a word of one to four glyphs that no other word has. The other reading leaves out every
# seventh glyph or so, has glyphs of its own, joins some words and splits others at their third glyph
GLYPHS_SQL = """told as (select l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as j, 1 + cast(l_quantity as int) % 4 as k, l_partkey, l_suppkey from lineitem),
glyphs as (select line, j, i, row_number() over (partition by line order by j, i) - 1 as g, (line + j * 5 + i) % 7 = 0 as left_out, (line * 3 + j + i * 2) % 11 = 0 as more,
  (i = 0 and (line + j) % 5 <> 0) or (i = 2 and (line + j) % 6 = 1) as brk from (select *, unnest(range(k)) as i from told)),
cut as (select *, sum(case when brk then 1 else 0 end) over (partition by line order by g) as of from glyphs),
own as (select line, of, g, 0 as extra from cut where not left_out union all select line, of, g, 1 from cut where more),
near as (select line, of, g, extra, max(case when extra = 0 then g end) over w as before, min(case when extra = 0 then g end) over v as after_ from own
  window w as (partition by line order by g, extra rows between unbounded preceding and current row), v as (partition by line order by g, extra rows between current row and unbounded following)),
sized as (select line, max(g) + 1 as m from glyphs group by line),
runs as (select n.*, coalesce(after_, m) - coalesce(before, -1) - 1 as gap, count(*) over (partition by line, extra, before, after_) as many, row_number() over (partition by line, extra, before, after_ order by g) - 1 as r from near n join sized using (line)),
spots as (select line, of, case when extra = 0 then g when gap > 0 then coalesce(before, -1) + 1 + r * gap / many else coalesce(before, -1) + 0.5 end as p from runs),
wants as (select line, of, min(p) as j0, max(p) + 1 as j1 from spots group by line, of),
has as (select g.line, g.j as word, min(g) as a, max(g) + 1 as b from glyphs g group by g.line, g.j),
boxes as (select line, j as word, case when line % 13 = 0 and j >= 3 then 'b' else 'a' end as panel, 100.0 * j as x, 10.0 * (line % 10) as y, case when l_partkey % 9 = 0 then 10.0 else 20.0 * k end as w, case when l_partkey % 9 = 0 then 40.0 else 15.0 end as h, l_suppkey % 17 = 0 as est
  from told where l_partkey % 10 <> 3),
parts as (select w.line, of, h.word, panel, x, y, w, bx.h, est, greatest(0.0, (j0 - a) / (b - a)) as f0, least(1.0, (j1 - a) / (b - a)) as f1
  from wants w join has h on h.line = w.line and b > j0 and a < j1 join boxes bx on bx.line = h.line and bx.word = h.word),
kept as (select *, bool_and(f0 <= 0.05 and f1 >= 0.95) over (partition by line, of) as whole, count(*) over (partition by line, of, panel) as np, min(word) over (partition by line, of, panel) as fp from parts where f1 - f0 >= 0.15),
main as (select *, first_value(panel) over (partition by line, of order by np desc, fp) as main from kept)"""


@query(f"""with {GLYPHS_SQL} select line, cast(of as int) as word, any_value(panel) as panel, round(min(x + case when w >= h then w * f0 else 0 end), 6) as x0, round(min(y + case when w < h then h * f0 else 0 end), 6) as y0,
  round(max(x + case when w >= h then w * f1 else w end), 6) as x1, round(max(y + case when w < h then h * f1 else h end), 6) as y1, bool_or(est) or not bool_and(whole) as est from main where panel = main group by line, of""")
def boxes_by_glyphs(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    told = li.select(F.col("l_orderkey").alias("line"), j.alias("j"), (1 + F.col("l_quantity").cast("int") % 4).alias("k"), "l_partkey", "l_suppkey")
    each = told.select("line", "j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    line, j, i = F.col("line"), F.col("j"), F.col("i")
    brk = ((i == 0) & ((line + j) % 5 != 0)) | ((i == 2) & ((line + j) % 6 == 1))
    of = F.sum(brk.cast("int")).over(Window.partitionBy("line").orderBy("j", "i")).cast("int")
    code = F.concat(F.char(65 + j), i)
    own = F.concat(F.when((line + j * 5 + i) % 7 != 0, F.array(code)).otherwise(F.array()), F.when((line * 3 + j + i * 2) % 11 == 0, F.array(F.concat(F.lit("Z"), j, F.lit("."), i))).otherwise(F.array()))
    told_each = each.withColumns({"of": of, "code": code, "own": own}).withColumn("own_of", F.array_repeat("of", F.size("own")))
    rows = told_each.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("j", "i", "code", "own", "own_of"))).alias("g"))
    lines = rows.select("line", F.flatten("g.own").alias("own"), F.flatten("g.own_of").alias("own_word"), F.col("g.code").alias("shown"), F.col("g.j").alias("shown_word"))
    tall = F.col("l_partkey") % 9 == 0
    boxes = told.filter("l_partkey % 10 <> 3").select(
        "line", F.col("j").alias("word"), F.when((F.col("line") % 13 == 0) & (F.col("j") >= 3), "b").otherwise("a").alias("panel"), (100.0 * F.col("j")).alias("x"), (10.0 * (F.col("line") % 10)).alias("y"),
        F.when(tall, 10.0).otherwise(20.0 * F.col("k")).alias("w"), F.when(tall, 40.0).otherwise(15.0).alias("h"), (F.col("l_suppkey") % 17 == 0).alias("est"),
    )
    out = B.transfer_by_glyphs(lines, boxes)
    return out.select("line", "word", "panel", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "est")


# customers of every second nation are the pages set aside: four witnesses of a line, of which LU has b for a, d for c,
# and, at places, b for what the others have as x and a. By strokes b is like x, so only costs that are fitted set it against a
FIT = V.Alphabet({chr(65 + i) + "1": chr(97 + i) for i in range(24)}, strokes={chr(65 + i) + "1": f"{chr(97 + i)}1" for i in range(24)} | {"B1": "s1", "X1": "s2"})


@query("""with c as (select c_custkey as k from customer where c_nationkey % 2 = 0),
n as (select 'a' as a, 'b' as b, cast(count(*) filter (k % 3 = 0) + count(*) filter (k % 5 = 0) as double) as n from c union all select 'c', 'd', count(*) filter (k % 4 = 0) from c)
select a, b, n, round(0.15 + 0.45 * (1 - ln(n) / ln(max(n) over ())), 3) as cost from n where n >= 10""")
def costs_fitted(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey % 2 = 0")
    k = F.col("c_custkey")
    near = F.translate(F.substring(F.md5(k.cast("string").cast("binary")), 1, 8), "0123456789abcdef", "efghijklefghijkl")
    n = lambda a, m: F.substring(near, a, m)
    line = lambda a, c, x: F.concat(n(1, 2), a, n(3, 2), c, n(5, 2), x, n(7, 2))
    most = line(F.lit("a"), F.lit("c"), F.lit("xa"))
    other = line(F.when(k % 3 == 0, "b").otherwise("a"), F.when(k % 4 == 0, "d").otherwise("c"), F.when(k % 5 == 0, "b").otherwise("xa"))
    coded = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.when(x == "", "").otherwise(F.concat(F.upper(x), F.lit("1")))), "")
    ways = F.array(*(F.struct(F.lit(w).alias("witness"), coded(other if w == "LU" else most).alias("text")) for w in ("ZL", "GC", "IT", "LU")))
    lines = c.select(k.cast("string").alias("locus"), F.explode(ways).alias("w")).select("locus", "w.witness", "w.text")
    return V.fit_costs(lines, FIT).select("a", "b", "n", "cost")


# an order is a page with one line, its items the words: on a ring of radius 300 about the middle, of which every fourth
# box is only estimated; along a ray from the middle; on a line that slants by 15 degrees; or level
@query("""with told as (select l_orderkey as page, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as word, count(*) over (partition by l_orderkey) as n from lineitem)
select page, word, case when page % 4 = 0 and n >= 6 then 'a' when page % 4 = 1 and n >= 2 or page % 4 = 2 and n >= 3 then 'o' else 'r' end as shape, page % 4 = 0 and word % 4 = 3 as est, true as close from told""")
def word_shapes(spark, sf_dir):
    """close: centre within 5, radius within 12 (boxes of arcs are wider than the writing), angles within 3 degrees of what was drawn."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = Window.partitionBy("l_orderkey")
    no = F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    page, j, kind = F.col("page"), F.col("word"), F.col("page") % 4
    told = li.select(F.col("l_orderkey").alias("page"), no.cast("int").alias("word"), F.count("*").over(by).alias("n"))
    turn = F.when(page % 8 == 0, 1).otherwise(-1)
    # the last word of a ring, if only estimated, stands at the ring's own spacing behind the one before
    mid = page % 360 + turn * (14.0 * j - F.when((j == F.col("n") - 1) & (j % 4 == 3), 7.4).otherwise(0.0))
    ray = (page % 360).cast("double")
    dx, dy = F.cos(F.radians(ray)), F.sin(F.radians(ray))
    at = 100 + 60.0 * j
    middle = lambda x, y, w, h: F.struct((x - w / 2).alias("x"), (y - h / 2).alias("y"), w.alias("w"), h.alias("h"))
    on_ray = middle(500 + at * dx, 500 + at * dy, 40 * F.abs(dx) + 12 * F.abs(dy), 40 * F.abs(dy) + 12 * F.abs(dx))
    level = middle(100 + 50.0 * j, 100 + F.when(kind == 2, 50.0 * j * F.tan(F.radians(F.lit(15.0)))).otherwise(0.0), F.lit(40.0), F.lit(14.0))
    box = F.when(kind == 0, G.arc_box(F.lit(500.0), F.lit(500.0), F.lit(290.0), F.lit(310.0), mid - 3, mid + 3)).when(kind == 1, on_ray).otherwise(level)
    words = told.withColumns({"mid": mid, "ray": ray}).withColumn("b", box).select(
        "page", "word", "mid", "ray", F.lit(0).alias("line"), F.when(kind == 0, "C").when(kind == 1, "R").otherwise("P").alias("kind"), F.lit(6).alias("glyphs"),
        F.col("b.x").alias("x0"), F.col("b.y").alias("y0"), (F.col("b.x") + F.col("b.w")).alias("x1"), (F.col("b.y") + F.col("b.h")).alias("y1"), ((kind == 0) & (j % 4 == 3)).alias("est"),
    )
    words = stored(words, "drawn")  # read several times
    out = H.shapes(words.drop("mid", "ray")).join(words.select("page", "word", "mid", "ray"), ["page", "word"])
    p = lambda k: F.get("p", F.lit(k))
    arc = (F.hypot(p(0) - 500, p(1) - 500) <= 5) & (F.abs((p(2) + p(3)) / 2 - 300) <= 12) & (F.abs(G.wrapped((p(4) + p(5)) / 2 - F.col("mid"))) <= 3)
    turned = F.abs(G.wrapped(F.col("angle") - F.when(kind == 1, F.col("ray")).otherwise(15.0))) <= 3
    return out.select("page", "word", "shape", "est", F.when(F.col("shape") == "a", arc).when(F.col("shape") == "o", turned).otherwise(F.col("angle") == 0).alias("close"))


# an order is a line, an item a word of two letters that stand nowhere else in it. Two transcriptions lack every tenth
# line, drop some second letters, have a 7 for others, and leave out some spaces
LINES_SQL = """told as (select l_orderkey as k, o_custkey as page, o_orderpriority as section, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as j from lineitem join orders on o_orderkey = l_orderkey),
items as (select t.*, m, name, chr(cast(97 + 2 * j as int)) as x, chr(cast(98 + 2 * j as int)) as y, case when j = 0 then '' when (k + j) % 4 = 0 then ',' else '.' end as sep from told t, (values (0, 'VT'), (1, 'RF')) v(m, name)),
lines as (select name, page, section, k as locus, m, string_agg(sep || x || y, '' order by j) as c,
  string_agg(case when (k + 2 * j + m) % 7 = 0 then '' else sep end || x || case when (k * 3 + j + m) % 5 = 0 then '' when (k + j * 2 + m) % 9 = 0 then '7' else y end, '' order by j) as whole from items group by all),
pairs as (select *, case when (locus + m) % 10 = 0 then null else whole end as o from lines),
split as (select *, list_filter(regexp_split_to_array(c, '[.,]'), lambda w: w <> '') as cw, list_filter(regexp_split_to_array(o, '[.,]'), lambda w: w <> '') as ow,
  list_filter(string_split(replace(c, ',', ''), '.'), lambda w: w <> '') as cj, list_filter(string_split(replace(o, ',', ''), '.'), lambda w: w <> '') as oj, regexp_replace(c, '[.,]', '', 'g') as cb, regexp_replace(o, '[.,]', '', 'g') as ob from pairs),
facts as (select name, page, section, locus, o is null as missing, len(cw) as words, cw = ow as same, cj = ow as joined_same, cb = ob as same_glyphs, len(list_filter(string_split(cb, ''), lambda g: contains(ob, g))) as match, greatest(length(cb), length(ob)) as glyphs,
  len(list_filter(cw, lambda w: not list_contains(ow, w))) as differ, len(cj) as joined_words, len(list_filter(cj, lambda w: not list_contains(oj, w))) as joined_differ from split)"""
_SUMS = ", ".join(f"cast(coalesce(sum({c}) filter (not missing), 0) as bigint) as {c}" for c in ("words", "differ", "joined_words", "joined_differ", "glyphs", "match"))
TOTALS_SQL = f"""count(*) filter (not missing) as loci, count(*) filter (missing) as loci_missing, cast(coalesce(sum(words) filter (missing), 0) as bigint) as missing_words,
  count(*) filter (same) as same, count(*) filter (joined_same) as joined_same, count(*) filter (same_glyphs) as same_glyphs, {_SUMS} from facts"""


def _two_readings(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("section"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    told = li.select(F.col("l_orderkey").alias("k"), "page", "section", j.alias("j"))
    k, j = F.col("k"), F.col("j")
    x, y = F.char(97 + 2 * j), F.char(98 + 2 * j)
    sep = F.when(j == 0, "").when((k + j) % 4 == 0, ",").otherwise(".")
    other = lambda m: F.concat(F.when((k + 2 * j + m) % 7 == 0, "").otherwise(sep), x, F.when((k * 3 + j + m) % 5 == 0, "").when((k + j * 2 + m) % 9 == 0, "7").otherwise(y))
    items = told.select("page", "section", F.col("k").alias("locus"), F.struct("j", F.concat(sep, x, y).alias("c"), other(0).alias("o0"), other(1).alias("o1")).alias("i"))
    lines = items.groupBy("page", "section", "locus").agg(F.array_sort(F.collect_list("i")).alias("i"))
    joined = lambda c: F.array_join(F.col(f"i.{c}"), "")
    lines = lines.select("page", "section", "locus", joined("c").alias("c"), joined("o0").alias("o0"), joined("o1").alias("o1"))
    told = lambda m, name: F.struct(F.lit(name).alias("name"), F.when((F.col("locus") + m) % 10 != 0, F.col(f"o{m}")).alias("o"))
    return lines.select("page", "section", "locus", "c", F.explode(F.array(told(0, "VT"), told(1, "RF"))).alias("v")).select("v.name", "page", "section", "locus", "c", "v.o")


@query(f"with {LINES_SQL} select name, section, {TOTALS_SQL} group by name, section")
def comparison_by_section(spark, sf_dir):
    return M.totals(M.compared(_two_readings(spark, sf_dir), edits=False), "name", "section")


@query(f"with {LINES_SQL} select name, page, section, {TOTALS_SQL} group by name, page, section")
def comparison_by_page(spark, sf_dir):
    return M.totals(M.compared(_two_readings(spark, sf_dir), edits=False), "name", "page", "section")


_PERCENT = "case when {w} > 0 then ((2000 * {p} + {w}) // (2 * {w})) // 10 || '.' || ((2000 * {p} + {w}) // (2 * {w})) % 10 || '%' else '-' end"
_CELLS = ", ".join(f"('{label}', {k}, " + (f"{p}::varchar" if w is None else _PERCENT.format(p=p, w=w)) + ")" for k, (label, p, w) in enumerate(M.ROWS, 1))


@query(f"with {LINES_SQL}, t as (select name, {TOTALS_SQL} group by name), c as (select name, v.label as measure, cast(v.k as int) as row, v.v from t, lateral (values {_CELLS}) v(label, k, v)) select row, measure, max(v) filter (name = 'VT') as VT, max(v) filter (name = 'RF') as RF from c group by row, measure")
def comparison_table(spark, sf_dir):
    """The first table of the report, read back from its lines."""
    facts = stored(M.compared(_two_readings(spark, sf_dir)), "compared")
    lines = M.comparison_report(facts, ["VT", "RF"], "The record against two transcriptions")
    cells = F.split("value", r" ?\| ?")
    first = lines.filter(F.col("row").between(7, 12)).select((F.col("row") - 6).cast("int").alias("row"), cells.alias("c"))
    return first.select("row", F.get("c", F.lit(1)).alias("measure"), F.get("c", F.lit(2)).alias("VT"), F.get("c", F.lit(3)).alias("RF"))


# a customer is a sheet, its orders lines of words of twenty letters, read off the sheet order by order: some second words
# are read as two, some fourth and fifth as one, some third not at all, and of every eleventh line nothing
SHEET_SQL = """told as (select o_custkey as page, l_orderkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
  count(*) over (partition by l_orderkey) as n from lineitem join orders on o_orderkey = l_orderkey),
kinds as (select *, case when line % 11 = 0 then 'none' when pos = 2 and n >= 3 and line % 3 = 0 then 'split' when pos in (4, 5) and n >= 5 and line % 5 = 0 then 'join' when pos = 3 and line % 7 = 3 then 'none' else 'whole' end as kind from told)"""


@query(f"""with {SHEET_SQL} select page, line, cast(pos as int) as pos, case when kind = 'join' then line || ':4:0' when kind = 'split' then line || ':2:0 ' || line || ':2:1' else line || ':' || pos || ':0' end as readings, kind,
  case when kind = 'join' and pos = 5 then 0.5 else 0.0 end::double as first, case when kind = 'join' and pos = 4 then 0.5 else 1.0 end::double as last from kinds where kind <> 'none'""")
def sheet_matched(spark, sf_dir):
    words = _page_words(spark, sf_dir).select("page", "line", "pos", "n", _letters("line", "pos").alias("text"))
    line, pos = F.col("line"), F.col("pos")
    kind = F.when(line % 11 == 0, "none").when((pos == 2) & (F.col("n") >= 3) & (line % 3 == 0), "split").when(pos.isin(4, 5) & (F.col("n") >= 5) & (line % 5 == 0), "join").when((pos == 3) & (line % 7 == 3), "none").otherwise("whole")
    row = F.dense_rank().over(Window.partitionBy("page").orderBy("line"))
    words = stored(words.withColumns({"kind": kind, "y": 100.0 * row, "next": F.lead("text").over(Window.partitionBy("line").orderBy("pos"))}), "words")
    half = lambda k: F.struct(F.lit(k).alias("part"), F.substring("text", 1 + 10 * k, 10).alias("text"))
    whole = lambda t: F.array(F.struct(F.lit(0).alias("part"), t.alias("text")))
    parts = F.when(F.col("kind") == "split", F.array(half(0), half(1))).when(F.col("kind") == "join", F.when(pos == 4, whole(F.concat("text", "next"))).otherwise(F.array())).when(F.col("kind") == "whole", whole(F.col("text"))).otherwise(F.array())
    read = words.select("page", F.md5(line.cast("string").cast("binary")).alias("run"), "line", "pos", "y", F.explode(parts).alias("p"))
    read = read.select("page", "run", (pos * 2 + F.col("p.part")).alias("at"), F.concat_ws(":", "line", "pos", "p.part").alias("id"), "p.text", (40.0 * pos).alias("x"), "y", F.lit(None).cast("string").alias("region"))
    placed = words.select("page", "line", "pos", "text", F.lit(100.0).alias("x"), "y", F.lit(None).cast("double").alias("sure"), F.lit(None).cast("string").alias("region"))
    return T.match_sheet(placed, read).withColumn("readings", _joined("readings"))


# a customer is a line of eight letters in an order of its own, with ab in the middle, told by four witnesses; one of them
# adds a letter, three do, two read another, one leaves one out, writes one for two, or adds letters with a space between
VARIANTS = V.Alphabet({chr(65 + i) + "1": chr(97 + i) for i in range(24)}, strokes={chr(65 + i) + "1": f"{chr(97 + i)}1" for i in range(24)} | {"A1": "s1", "B1": "t1", "C1": "s1:t1"})
_N = "substr('efghijklefghijkl', 1 + cast(k % 8 as int) + {a}, {m})"


def _n(a, m=2):
    return _N.format(a=a, m=m)


# by case: what stands after the third letter for ZL, GC, IT and FG, then what the consensus and its apparatus have
VARIANTS_SQL = f"""w as (select c_custkey as k, c_custkey % 6 as kind from customer),
m as (select k, kind, {_n(0)} || '.' || {_n(2, 1)} || 'ab' || {_n(3, 1)} || {_n(4, 1)} || ',' || {_n(5, 1)} || '.' || {_n(6)} as plain,
  {_n(0)} || '.' || {_n(2, 1)} || 'abx' || {_n(3, 1)} || {_n(4, 1)} || ',' || {_n(5, 1)} || '.' || {_n(6)} as added, {_n(2, 1)} as third, {_n(4, 1)} as fifth from w)"""


@query(f"""with {VARIANTS_SQL}, told as (select cast(k as varchar) as locus, case when kind = 1 then added else plain end as c, case kind
    when 0 then '6:0:m:=3(ZL IT FG)|x=1(GC)' when 1 then '6:1:m:x=3(GC IT FG)|=1(ZL)' when 2 then '7:1:t:' || fifth || '=2(ZL GC)|o=2(IT FG)' when 3 then '3:1:m:' || third || '=3(ZL GC FG)|=1(IT)'
    when 4 then '4:2:m:ab=3(ZL IT FG)|c=1(GC)' else '6:0:m:=3(ZL GC IT)|xw=1(FG)' end as units, kind from m)
select locus, v.w as witness, c, units, kind = 5 and v.w = 'FG' as rough from told, (values ('ZL'), ('GC'), ('IT'), ('FG')) v(w)""")
def consensus_of_variants(spark, sf_dir):
    k = F.col("c_custkey")
    kind = k % 6
    n = lambda a, m=2: F.substring(F.lit("efghijklefghijkl"), 1 + (k % 8).cast("int") + a, F.lit(m))
    say = lambda third, ab, more, fifth: F.concat(n(0), F.lit("."), third, ab, more, n(3, 1), fifth, F.lit(","), n(5, 1), F.lit("."), n(6))
    one, none = lambda case, x, y: F.when(kind == case, x).otherwise(y), F.lit("")
    third, ab, fifth = n(2, 1), F.lit("ab"), n(4, 1)
    x = one(1, F.lit("x"), none)
    texts = {
        "ZL": say(third, ab, none, fifth),
        "GC": say(third, one(4, F.lit("c"), ab), F.when(kind == 0, "x").otherwise(x), fifth),
        "IT": say(one(3, none, third), ab, x, one(2, F.lit("o"), fifth)),
        "FG": say(third, ab, F.when(kind == 5, "x.w").otherwise(x), one(2, F.lit("o"), fifth)),
    }
    coded = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.isin(".", ","), c).when(c == "", "").otherwise(F.concat(F.upper(c), F.lit("1")))), "")
    ways = F.array(*(F.struct(F.lit(w).alias("w"), coded(t).alias("t")) for w, t in texts.items()))
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("locus"), F.explode(ways).alias("x")).select("locus", F.col("x.w").alias("witness"), F.col("x.t").alias("text"))
    told = V.records(spread(lines, "locus"), VARIANTS)
    unit = "array<struct<off:int,len:int,status:string,rows:array<array<string>>>>"
    u = F.from_json("record", f"u {unit}")["u"]
    reading = lambda r: F.concat(F.get(r, F.lit(0)), F.lit("="), F.get(r, F.lit(1)).cast("double").cast("int").cast("string"), F.lit("("), F.get(r, F.lit(2)), F.lit(")"))
    units = F.array_join(F.transform(u, lambda x: F.concat_ws(":", x["off"], x["len"], x["status"], F.array_join(F.transform(x["rows"], reading), "|"))), ";")
    # what is rebuilt is the witness's line, or the record keeps the line
    return told.filter(F.col("same") != F.col("rough")).select("locus", "witness", "c", units.alias("units"), "rough")
