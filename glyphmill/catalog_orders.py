"""Queries of the order algebra: customers' orders play sheets, market segments gatherings, nations books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.catalog import query
from glyphmill.operators import orders as O

# every nation is an order; its customers are sheets, in gatherings by market segment; the alternative order goes by balance
SHEETS_SQL = """sheets as (
  select 'n' || c_nationkey as order_id, cast(dense_rank() over (partition by c_nationkey order by c_mktsegment) as int) as gi, c_mktsegment as quire,
         case when c_mktsegment < 'F' then 'nested' else 'singulions' end as type, cast(row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as int) as pos, cast(c_custkey as varchar) as sheet from customer
  union all
  select 'b' || c_nationkey, cast(dense_rank() over (partition by c_nationkey order by c_mktsegment) as int), c_mktsegment, 'nested',
         cast(row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey) as int), cast(c_custkey as varchar) from customer)"""
SIDES_SQL = SHEETS_SQL + """,
faces as (select s.*, f.face, count(*) over (partition by order_id, gi) // 4 as n, dense_rank() over (partition by order_id, gi order by pos) - 1 as r from sheets s, (select unnest(range(4)) as face) f),
keyed as (select *, case when type = 'nested' then case when face < 2 then 2 * r + face else 4 * n - 2 * r - 4 + face end else 4 * r + face end as k from faces),
sides as (select order_id, row_number() over (partition by order_id order by gi, k) - 1 as side, gi, quire, sheet, face from keyed),
opened as (select order_id, (side + 1) // 2 as opening, max(case when side % 2 = 1 then sheet || ':' || face end) as a, max(case when side % 2 = 0 then sheet || ':' || face end) as b from sides group by 1, 2)"""


def _sheets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    gi = F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment"))
    place = Window.partitionBy("c_nationkey", "c_mktsegment")

    def order(letter, kind, *by):
        return c.select(F.concat(F.lit(letter), F.col("c_nationkey")).alias("order_id"), gi.alias("gi"), F.col("c_mktsegment").alias("quire"), kind.alias("type"), F.row_number().over(place.orderBy(*by)).alias("pos"), F.col("c_custkey").cast("string").alias("sheet"))

    first = order("n", F.when(F.col("c_mktsegment") < "F", "nested").otherwise("singulions"), "c_custkey")
    return first.unionByName(order("b", F.lit("nested"), "c_acctbal", "c_custkey"))


@query(f"with {SIDES_SQL} select order_id, cast(side as int) as side, gi, quire, sheet, cast(face as int) as face from sides")
def order_linearize(spark, sf_dir):
    return O.linearise(_sheets(spark, sf_dir))


@query(f"with {SIDES_SQL} select order_id, cast(opening as bigint) as opening, a, b from opened")
def order_openings(spark, sf_dir):
    return O.openings(O.linearise(_sheets(spark, sf_dir)))


@query(f"with {SIDES_SQL}, p as (select order_id, least(a, b) || ' ' || greatest(a, b) as pair from opened where a is not null and b is not null) select distinct pair from p where order_id = 'b3' and pair not in (select pair from p where order_id = 'n3')")
def order_new_pairs(spark, sf_dir):
    return O.new_pairs(O.linearise(_sheets(spark, sf_dir)), "b3", "n3")


@query()
def order_changes(spark, sf_dir):
    return O.moved(_sheets(spark, sf_dir), "b3", "n3")


RESOLVE = "(values ('base', cast(null as varchar)), ('child', 'base'), ('grand', 'child'))"


@query("""with o as (select * from (values ('child', 'base', 1), ('grand', 'child', 1), ('grand', 'base', 2)) o(order_id, up, level)),
s as (select 'base' as order_id, r_regionkey + 1 as gi, r_name as quire, 'nested' as type, n_nationkey as pos, n_name as sheet from nation join region on n_regionkey = r_regionkey
  union all select 'child', 1, r_name, 'singulions', -n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_regionkey = 2
  union all select 'grand', 1, r_name, 'nested', 100 - n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_regionkey = 4),
a as (select order_id, gi, quire, type, pos, sheet, 0 as level from s union all select o.order_id, s.gi, quire, type, pos, sheet, level from o join s on s.order_id = o.up),
f as (select *, min(level) over (partition by order_id, quire) as first, max(level) over (partition by order_id) as deepest from a),
p as (select *, coalesce(max(case when level = deepest then gi end) over (partition by order_id, quire), gi + 10000) as plc from f)
select order_id, cast(dense_rank() over (partition by order_id order by plc) as int) as gi, quire, type, cast(pos as int) as pos, sheet from p where level = first""")
def order_resolve(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.select(F.lit("base").alias("order_id"), (F.col("r_regionkey") + 1).alias("gi"), F.col("r_name").alias("quire"), F.lit("nested").alias("type"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("sheet"))
    child = base.filter("gi = 3").withColumns({"order_id": F.lit("child"), "gi": F.lit(1), "type": F.lit("singulions"), "pos": -F.col("pos")})
    grand = base.filter("gi = 5").withColumns({"order_id": F.lit("grand"), "gi": F.lit(1), "pos": 100 - F.col("pos")})
    orders = spark.createDataFrame([("base", None), ("child", "base"), ("grand", "child")], "order_id string, base string")
    return O.resolve(orders, base.unionByName(child).unionByName(grand))


@query("with f as (select o_custkey % 50 as opening, o_orderkey % 2 as half, o_orderpriority || case when o_orderkey % 3 = 0 then ' (part)' else '' end as panel from orders), b as (select opening, half, regexp_replace(panel, ' *\\([^)]*\\)$', '') as panel from f) select distinct least(l.panel, r.panel) as x, greatest(l.panel, r.panel) as y from b l join b r on l.opening = r.opening and l.half = 0 and r.half = 1")
def facing_pairs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    panel = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, " (part)").otherwise(""))
    return O.facing_pairs(o.select((F.col("o_custkey") % 50).alias("opening"), (F.col("o_orderkey") % 2).alias("half"), panel.alias("panel")).distinct())


@query("with p as (select p_size as sheet, p_partkey as panel, p_retailprice as x0, p_retailprice + 40 as x1, p_partkey as z from part) select sheet, a, b from (select l.sheet, l.panel as a, arg_min(h.panel, h.z) as b from p l join p h on l.sheet = h.sheet and h.z > l.z and h.x0 < l.x1 and l.x0 < h.x1 group by l.sheet, l.panel)")
def fold_contacts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return O.contacts(p.select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("panel"), F.col("p_retailprice").alias("x0"), (F.col("p_retailprice") + 40).alias("x1"), F.col("p_partkey").alias("z")))
