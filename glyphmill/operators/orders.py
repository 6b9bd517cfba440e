"""Reading orders: inheritance, linearisation of nested sheets, openings, new pairs, differences, edits.

An order's sheets are rows order_sheets(order_id, gi, quire, type, pos, sheet, ...): gathering number, its quire and type
(nested or singulions), and the sheet's place in it. Functions over frames are relational; edits of one order, whose
size is a book's, are pure functions on lists of gatherings.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.shipping import ship, spread


def resolve(orders: DataFrame, sheets: DataFrame) -> DataFrame:
    """order_sheets with what orders(order_id, base) leave to their base: a quire's gathering replaces the base's of that name.

    Each turn takes gatherings of the next base for quires still missing, until no order has a further base; a chain
    of bases that comes back to itself raises.
    """
    rows = {r["order_id"]: r["base"] for r in orders.collect()}  # a row for each order, as many as a person keeps
    up = []
    for order in rows:
        at, level, seen = rows[order], 1, {order}
        while at is not None:
            if at in seen:
                raise ValueError(f"order {order} is based on itself")
            up.append((order, at, level))
            seen.add(at)
            at, level = rows.get(at), level + 1
    sheets = sheets.select("order_id", "gi", "quire", "type", "pos", "sheet")
    bases = sheets.sparkSession.createDataFrame(up, "order_id string, up string, level int")
    inherited = F.broadcast(bases).join(sheets.withColumnRenamed("order_id", "up"), "up").select("order_id", "gi", "quire", "type", "pos", "sheet", "level")
    out = sheets.withColumn("level", F.lit(0)).unionByName(inherited)
    first = F.min("level").over(Window.partitionBy("order_id", "quire"))
    deepest = F.max("level").over(Window.partitionBy("order_id"))
    # a gathering stands where the oldest base has it
    kept = out.withColumn("first", first).withColumn("deepest", deepest)
    place = F.max(F.when(F.col("level") == F.col("deepest"), F.col("gi"))).over(Window.partitionBy("order_id", "quire"))
    kept = kept.withColumn("at", F.coalesce(place, F.col("gi") + 10_000)).filter("level = first")
    return kept.select("order_id", F.dense_rank().over(Window.partitionBy("order_id").orderBy("at")).cast("int").alias("gi"), "quire", "type", "pos", "sheet")


def linearise(sheets: DataFrame) -> DataFrame:
    """order_id, side, gi, quire, sheet, face: page sides from front to back, numbered from 0.

    A nested gathering gives every sheet's faces 0 and 1 going in, then 2 and 3 coming out; others all four in turn.
    """
    n = F.count("*").over(Window.partitionBy("order_id", "gi"))
    rank = F.row_number().over(Window.partitionBy("order_id", "gi").orderBy("pos")) - 1
    faces = sheets.withColumn("n", n).withColumn("r", rank).withColumn("face", F.explode(F.array(*map(F.lit, range(4)))))
    nested = F.when(F.col("face") < 2, 2 * F.col("r") + F.col("face")).otherwise(4 * F.col("n") - 2 * F.col("r") - 4 + F.col("face"))
    key = F.when(F.col("type") == "nested", nested).otherwise(4 * F.col("r") + F.col("face"))
    return faces.withColumn("key", key).select("order_id", (F.row_number().over(Window.partitionBy("order_id").orderBy("gi", "key")) - 1).alias("side"), "gi", "quire", "sheet", "face")


def openings(sides: DataFrame) -> DataFrame:
    """order_id, opening, a, b: what is seen together; the first side stands alone."""
    told = sides.withColumn("opening", F.floor((F.col("side") + 1) / 2))
    name = F.concat_ws(":", "sheet", "face")
    return told.groupBy("order_id", "opening").agg(F.max(F.when(F.col("side") % 2 == 1, name)).alias("a"), F.max(F.when(F.col("side") % 2 == 0, name)).alias("b"))


def new_pairs(sides: DataFrame, order: str, base: str) -> DataFrame:
    """Openings of two sides that order has and base has not, in either direction."""
    both = openings(sides).filter("a is not null and b is not null").select("order_id", F.array_join(F.array_sort(F.array("a", "b")), " ").alias("pair"))
    return both.filter(F.col("order_id") == order).select("pair").distinct().join(both.filter(F.col("order_id") == base).select("pair"), "pair", "left_anti")


def facing_pairs(faces: DataFrame) -> DataFrame:
    """Pairs of panels on the two sides of an opening: faces(opening, half, panel); a part in brackets doesn't name another panel."""
    bare = faces.withColumn("panel", F.regexp_replace("panel", r" *\([^)]*\)$", ""))
    left, right = bare.filter("half = 0").select("opening", F.col("panel").alias("x")), bare.filter("half = 1").select("opening", F.col("panel").alias("y"))
    return left.join(right, "opening").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def moved(sheets: DataFrame, order: str, source: str) -> DataFrame:
    """sheet, was, now, state over both orders: same, moved, new or gone, by quire and the kept order within it."""
    ship(sheets.sparkSession)

    def side(name: str, col: str) -> DataFrame:
        return sheets.filter(F.col("order_id") == name).select("sheet", F.struct("quire", "pos").alias(col))

    both = side(source, "was").join(side(order, "now"), "sheet", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was.quire") != F.col("now.quire"), "moved")
    told = both.select("sheet", F.col("was.quire").alias("was"), F.col("now.quire").alias("now"), F.col("was.pos").alias("p"), F.col("now.pos").alias("q"), state.alias("state"))
    kept = told.filter("state is null").groupBy("now").agg(F.array_sort(F.collect_list(F.struct("q", "p", "sheet"))).alias("r"))  # the sheets of one quire
    here = kept.select(F.explode(_kept_sheets("r")).alias("sheet")).withColumn("kept", F.lit(True))
    return told.join(here, "sheet", "left").select("sheet", "was", "now", F.coalesce("state", F.when(F.col("kept"), "same").otherwise("moved")).alias("state"))


def _kept_sheets(column: str) -> Column:
    return F.udf(lambda rows: [rows[k]["sheet"] for k in longest_rise([x["p"] for x in rows])], "array<string>", useArrow=True)(column)


def longest_rise(values: list[int]) -> list[int]:
    """Places of the longest strictly increasing choice; of equals, the first found."""
    length, before = [], []
    for i, v in enumerate(values):
        best = max((j for j in range(i) if values[j] < v), key=lambda j: (length[j], -j), default=None)
        before.append(best)
        length.append(1 + (length[best] if best is not None else 0))
    at = max(range(len(values)), key=lambda i: (length[i], -i), default=None)
    out = []
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def handled(faces: Column, spine: Column, n: Column, inside_out: Column, rot180: Column) -> Column:
    """(faces, spine) of a sheet turned as its options say: inside out swaps faces, half a turn reverses rows and columns."""
    swapped = F.when(inside_out, F.reverse(faces)).otherwise(faces)
    turned = F.when(rot180, F.transform(swapped, lambda f: F.reverse(F.transform(f, lambda row: F.reverse(row))))).otherwise(swapped)
    flips = inside_out.cast("int") + rot180.cast("int")
    return F.struct(turned.alias("faces"), F.when(flips == 1, n - spine).otherwise(spine).alias("spine"))


def handled_sheets(sheets: DataFrame) -> DataFrame:
    """sheets(sheet, inside, outside, spine, proper, new_spine, inside_out, rot180) as they are handled.

    inside and outside are rows of panels. A spine given anew replaces the sheet's; half a turn also flips the proper
    row and turns every panel by 180 degrees (column rot). plain: no option is set.
    """
    n, out, half = F.size(F.col("inside")[0]), F.coalesce("inside_out", F.lit(False)), F.coalesce("rot180", F.lit(False))
    told = handled(F.array("inside", "outside"), F.coalesce("new_spine", "spine"), n, out, half)
    proper = F.coalesce("proper", F.size("inside") - 1)
    return sheets.withColumn("v", told).select(
        "sheet", n.alias("n"), F.col("v.faces")[0].alias("inside"), F.col("v.faces")[1].alias("outside"), F.col("v.spine").alias("spine"),
        F.when(half, F.size("inside") - 1 - proper).otherwise(proper).alias("proper"), F.when(half, 180).otherwise(0).alias("rot"),
        (F.coalesce("new_spine", F.lit(0)).eqNullSafe(0) & ~out & ~half).alias("plain"), *([c for c in ("read",) if c in sheets.columns]),
    )


def sides_of(sheets: DataFrame) -> DataFrame:
    """sheet, side, face, hinge, panels, proper_panel, shown: the four page sides of handled_sheets folded at the spine, as read.

    The inside sides fold onto themselves, so of several panels the back of the second is what shows. An explicit
    reading (array read of panels by side) replaces what shows on sheets without options.
    """
    n, spine = F.col("n"), F.col("spine")
    row_in, row_out = F.get("inside", F.col("proper")), F.get("outside", F.col("proper"))

    def side(k, face, row, start, many, hinge):
        panels = F.slice(row, start + 1, many)
        own = F.get(panels, F.lit(0)) if hinge == "left" else F.get(panels, many - 1)
        second = start + 1 if hinge == "left" else start + many - 2
        shown = F.when(many > 1, F.get(row_out, n - 1 - second)).otherwise(own) if face == "inside" else own
        return F.struct(F.lit(k).alias("side"), F.lit(face).alias("face"), F.lit(hinge).alias("hinge"), panels.alias("panels"), own.alias("proper_panel"), shown.alias("shown"))

    four = F.array(side(0, "outside", row_out, n - spine, spine, "left"), side(1, "inside", row_in, F.lit(0), spine, "right"), side(2, "inside", row_in, spine, n - spine, "left"), side(3, "outside", row_out, F.lit(0), n - spine, "right"))
    told = sheets.select("*", F.explode(four).alias("s")).select("*", "s.*")
    if "read" in sheets.columns:
        given = F.get("read", F.col("side"))
        known = F.array_contains(F.concat(F.flatten("inside"), F.flatten("outside")), given)
        told = told.withColumn("shown", F.when(F.col("plain") & F.coalesce(known, F.lit(False)), given).otherwise(F.col("shown")))
    return told.select("sheet", "side", "face", "hinge", "panels", "proper_panel", "shown")


def fold_way(pairs: DataFrame, folds: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet, a, b, way: 1 toward whoever looks, -1 away, for neighbouring panels pairs(sheet, a, b).

    folds(sheet, a, b, way) names inside panels, in either order, with way in or out; what isn't listed goes in. From
    the outside a fold that goes in turns away.
    """
    cell = lambda name: F.posexplode(name).alias("r", "row")
    outside = sheets.select("sheet", "inside", cell("outside")).select("sheet", "inside", "r", F.size("row").alias("m"), F.posexplode("row").alias("c", "panel"))
    backs = outside.select("sheet", "panel", F.get(F.get("inside", F.col("r")), F.col("m") - 1 - F.col("c")).alias("back"))
    of = lambda c: backs.select("sheet", F.col("panel").alias(c), F.col("back").alias(f"{c}_back"))
    told = pairs.join(of("a"), ["sheet", "a"], "left").join(of("b"), ["sheet", "b"], "left")
    out = F.col("a_back").isNotNull() | F.col("b_back").isNotNull()
    told = told.withColumn("out", out).withColumn("x", F.when(out, F.col("a_back")).otherwise(F.col("a"))).withColumn("y", F.when(out, F.col("b_back")).otherwise(F.col("b")))
    both = folds.select("sheet", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "way").dropDuplicates(["sheet", "low", "high"])
    told = told.withColumn("low", F.least("x", "y")).withColumn("high", F.greatest("x", "y")).join(both, ["sheet", "low", "high"], "left")
    way = F.when(F.col("way") == "out", -1).otherwise(1) * F.when(F.col("out"), -1).otherwise(1)
    return told.select("sheet", "a", "b", way.alias("way"))


def compare_orders(sheets: DataFrame, left: str, right: str) -> DataFrame:
    """row, quire, left_gi, right_gi, same: the gatherings of two orders side by side.

    Rows follow the right order; a gathering stands beside the left one of its name, the n-th beside the n-th; left ones
    without a partner come last. same: one type, the same sheets in the same places.
    """

    def side(order: str, name: str) -> DataFrame:
        one = sheets.filter(F.col("order_id") == order).groupBy("gi", "quire").agg(F.struct(F.first("type").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sheet"))), lambda x: x["sheet"]).alias("sheets")).alias(f"{name}_body"))
        nth = F.row_number().over(Window.partitionBy("quire").orderBy("gi"))
        return one.select("quire", nth.alias("nth"), F.col("gi").alias(f"{name}_gi"), f"{name}_body")

    both = side(right, "right").join(side(left, "left"), ["quire", "nth"], "full")
    row = F.row_number().over(Window.orderBy(F.col("right_gi").asc_nulls_last(), "left_gi"))  # the gatherings of one book
    return both.select(row.alias("row"), "quire", "left_gi", "right_gi", F.col("left_body").eqNullSafe(F.col("right_body")).alias("same"))


def leaf_table(sheets: DataFrame, order: str, source: str) -> DataFrame:
    """leaf, quire, sheet, recto, verso, state, new_recto, new_verso: an order's leaves, marked against a source order.

    state is that of moved; a side is new-facing if the side it is seen with isn't the one it is seen with in source.
    """
    sides = linearise(sheets.filter(F.col("order_id").isin(order, source)))
    partner = openings(sides).filter("a is not null and b is not null")
    seen = partner.select("order_id", F.col("a").alias("side"), F.col("b").alias("beside")).unionByName(partner.select("order_id", F.col("b").alias("side"), F.col("a").alias("beside")))
    here = seen.filter(F.col("order_id") == order).select(F.col("side").alias("name"), "beside")
    there = seen.filter(F.col("order_id") == source).select(F.col("side").alias("name"), F.col("beside").alias("was"))
    name = F.concat_ws(":", "sheet", "face")
    told = sides.filter(F.col("order_id") == order).withColumn("name", name).join(here, "name", "left").join(there, "name", "left")
    told = told.withColumn("new", F.col("beside").isNotNull() & ~F.col("beside").eqNullSafe(F.col("was")))
    leaf = F.floor(F.col("side") / 2).cast("int")
    of = lambda k, c: F.max(F.when(F.col("side") % 2 == k, F.col(c)))
    rows = told.groupBy(leaf.alias("leaf")).agg(F.first("quire").alias("quire"), F.first("sheet").alias("sheet"), of(0, "name").alias("recto"), of(1, "name").alias("verso"), of(0, "new").alias("new_recto"), of(1, "new").alias("new_verso"))
    return rows.join(moved(sheets, order, source).select("sheet", "state"), "sheet", "left").select("leaf", "quire", "sheet", "recto", "verso", "state", "new_recto", "new_verso")


def overlay(leaves: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sheet, leaf, values) and the legend (value, leaves) of leaves(sheet, leaf, value, missing): known values of both faces, once, in the categories' order."""
    place = F.create_map(*(F.lit(x) for k, c in enumerate(categories) for x in (c, k)))
    known = leaves.filter(~F.coalesce("missing", F.lit(False)) & F.col("value").isin(categories)).select("sheet", "leaf", "value").distinct()
    values = known.groupBy("sheet", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct(place[F.col("value")].alias("k"), "value"))), lambda x: x["value"]).alias("values"))
    return values, known.groupBy("value").agg(F.count("*").alias("leaves"))


#: A sheet's panels are dealt to stretches of so much of its width, over its mean panel's.
STRETCH = 16


def contacts(panels: DataFrame) -> DataFrame:
    """a, b: each panel's nearest one above that overlaps it; panels(sheet, panel, x0, x1, z).

    Sheets are cut into stretches. In one, panels are laid down from the highest z to the lowest: what shows at a place
    is the nearest one above, so a panel looks at what shows where it lies and then covers it. Panels without width,
    which cover nothing, are joined.
    """
    ship(panels.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    wide = panels.filter("x1 > x0").groupBy("sheet").agg((F.avg(F.col("x1") - F.col("x0")) * STRETCH).alias("_wide"))
    at = lambda c: F.floor(F.col(c) / F.col("_wide"))
    cut = panels.filter("x1 > x0 and z is not null").join(wide, "sheet")
    cut = cut.select("sheet", "panel", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "z", F.explode(F.sequence(at("x0"), at("x1"))).alias("_at"))

    def laid(table):
        import pyarrow as pa

        x0, x1, z = (table.column(c).to_pylist() for c in ("x0", "x1", "z"))
        # what shows from each place on, -1 for nothing; of one z none is above the other
        starts, shows, rows, above = [float("-inf")], [-1], [], []
        for _, same in groupby(sorted(range(len(z)), key=lambda n: z[n], reverse=True), key=lambda n: z[n]):
            same = list(same)
            for n in same:
                seen = [k for k in shows[bisect_right(starts, x0[n]) - 1 : bisect_left(starts, x1[n])] if k >= 0]
                if seen:
                    rows.append(n)
                    above.append(min(seen, key=lambda k: z[k]))
            for n in same:
                a, b = bisect_left(starts, x0[n]), bisect_right(starts, x1[n])
                starts[a:b], shows[a:b] = [x0[n], x1[n]], [n, shows[b - 1]]
        rows, above = pa.array(rows, pa.int64()), pa.array(above, pa.int64())
        return pa.Table.from_arrays([table.column("sheet").take(rows), table.column("panel").take(rows), table.column("panel").take(above), table.column("z").take(above)], ["sheet", "a", "b", "z"])

    near = spread(cut, "sheet", "_at").groupBy("sheet", "_at").applyInArrow(laid, f"sheet {kinds['sheet']}, a {kinds['panel']}, b {kinds['panel']}, z {kinds['z']}")
    flat = panels.filter("not x1 > x0")

    def joined(low, high):
        over = (F.col("l.sheet") == F.col("h.sheet")) & (F.col("h.z") > F.col("l.z")) & (F.col("h.x0") < F.col("l.x1")) & (F.col("l.x0") < F.col("h.x1"))
        return low.alias("l").join(high.alias("h"), over).select("l.sheet", F.col("l.panel").alias("a"), F.col("h.panel").alias("b"), "h.z")

    every = near.unionByName(joined(panels, flat)).unionByName(joined(flat, panels.filter("x1 > x0")))
    return every.groupBy("sheet", "a").agg(F.min_by("b", "z").alias("b"))


# edits: a book is a list of gatherings {"quire", "type", "bifolia"} and a list set aside; each returns a new book, or None if nothing changes


def _copy(book: dict) -> dict:
    out = {"gatherings": [dict(g, bifolia=list(g["bifolia"])) for g in book["gatherings"]], "unplaced": list(book.get("unplaced", []))}
    if book.get("options"):
        out["options"] = {s: dict(o) for s, o in book["options"].items()}
    return out


def _lift(book: dict, sheets: list[str]) -> dict:
    out = _copy(book)
    for g in out["gatherings"]:
        g["bifolia"] = [s for s in g["bifolia"] if s not in sheets]
    out["unplaced"] = [s for s in out["unplaced"] if s not in sheets]
    return out


def _tidy(book: dict, was: dict) -> dict | None:
    book["gatherings"] = [g for g in book["gatherings"] if g["bifolia"]]
    return None if book == _copy(was) else book


def move(book: dict, sheets: list[str], gathering: int, at: int) -> dict | None:
    """sheets, in their order in the book, to place at of a gathering (counted before the move)."""
    known = [s for g in book["gatherings"] for s in g["bifolia"]] + list(book.get("unplaced", []))
    sheets = [s for s in known if s in sheets]
    anchor = next((s for s in book["gatherings"][gathering]["bifolia"][at:] if s not in sheets), None)
    out = _lift(book, sheets)
    target = out["gatherings"][gathering]["bifolia"]
    put = target.index(anchor) if anchor is not None else len(target)
    target[put:put] = sheets
    return _tidy(out, book)


def step(book: dict, sheet: str, by: int) -> dict | None:
    """One sheet by places within its gathering."""
    out = _copy(book)
    for g in out["gatherings"]:
        if sheet in g["bifolia"]:
            at = g["bifolia"].index(sheet)
            g["bifolia"].remove(sheet)
            g["bifolia"].insert(max(0, min(len(g["bifolia"]), at + by)), sheet)
    return _tidy(out, book)


def new_gathering(book: dict, sheets: list[str], at: int | None = None, type_: str = "nested") -> dict | None:
    known = [s for g in book["gatherings"] for s in g["bifolia"]] + list(book.get("unplaced", []))
    out = _lift(book, sheets)
    out["gatherings"].insert(len(out["gatherings"]) if at is None else at, {"quire": free_name(book), "type": type_, "bifolia": [s for s in known if s in sheets]})
    return _tidy(out, book)


def merge(book: dict, first: int, second: int) -> dict | None:
    out = _copy(book)
    out["gatherings"][first]["bifolia"] += out["gatherings"][second]["bifolia"]
    out["gatherings"][second]["bifolia"] = []
    return _tidy(out, book)


def split(book: dict, gathering: int, at: int) -> dict | None:
    """Cuts a gathering in two, named with a and b after it."""
    g = book["gatherings"][gathering]
    if not 0 < at < len(g["bifolia"]):
        return None
    out = _copy(book)
    names = [f"{g['quire']}{c}" for c in string.ascii_lowercase if not name_clash(book, f"{g['quire']}{c}")][:2]
    out["gatherings"][gathering : gathering + 1] = [dict(g, quire=names[0], bifolia=g["bifolia"][:at]), dict(g, quire=names[1], bifolia=g["bifolia"][at:])]
    return out


def set_aside(book: dict, sheets: list[str]) -> dict | None:
    out = _lift(book, sheets)
    out["unplaced"] += sheets
    return _tidy(out, book)


def move_into(book: dict, sheets: list[str], gathering: int) -> dict | None:
    """sheets to the end of a gathering."""
    return move(book, sheets, gathering, len(book["gatherings"][gathering]["bifolia"]))


def group(book: dict, sheets: list[str]) -> dict | None:
    """sheets as a gathering of their own, where the first of them stood."""
    at = next((k for k, g in enumerate(book["gatherings"]) if set(g["bifolia"]) & set(sheets)), len(book["gatherings"]))
    return new_gathering(book, sheets, at + 1)


def paste(book: dict, sheets: list[str], after: str) -> dict | None:
    """Sheets that were cut, set down behind another sheet; nothing if that isn't in a gathering or is one of them."""
    place = next(((k, g["bifolia"].index(after)) for k, g in enumerate(book["gatherings"]) if after in g["bifolia"]), None)
    return move(book, sheets, place[0], place[1] + 1) if place and after not in sheets else None


def set_option(book: dict, sheet: str, option: str, value) -> dict | None:
    """How a sheet is handled: spine, inside_out or rot180; a value of None or False takes the option away."""
    if option not in ("spine", "inside_out", "rot180"):
        return None
    out = _copy(book)
    own = dict(out.get("options", {}).get(sheet, {}))
    own.pop(option, None)
    if value is not None and value is not False:
        own[option] = value
    every = {s: o for s, o in (out.get("options", {}) | {sheet: own}).items() if o}
    out.pop("options", None)
    if every:
        out["options"] = every
    return None if out == _copy(book) else out


def move_gathering_to(book: dict, gathering: int, before: int) -> dict | None:
    """A gathering to stand before another one, counted before the move."""
    return reorder(book, gathering, before - (before > gathering))


def reorder(book: dict, gathering: int, to: int) -> dict | None:
    out = _copy(book)
    out["gatherings"].insert(max(0, min(len(out["gatherings"]) - 1, to)), out["gatherings"].pop(gathering))
    return None if out == _copy(book) else out


def rename(book: dict, gathering: int, name: str) -> dict | None:
    name = name.strip()
    if not name or name_clash(book, name, gathering) or str(book["gatherings"][gathering]["quire"]) == name:
        return None
    out = _copy(book)
    out["gatherings"][gathering]["quire"] = name
    return out


def set_type(book: dict, gathering: int, type_: str) -> dict | None:
    if type_ not in ("nested", "singulions") or book["gatherings"][gathering]["type"] == type_:
        return None
    out = _copy(book)
    out["gatherings"][gathering]["type"] = type_
    return out


def put_back(book: dict, home: dict, sheets: list[str]) -> dict | None:
    """sheets to the gathering of that quire in the home order, at their place there; a missing gathering is made anew."""
    out = book
    for k, g in enumerate(home["gatherings"]):
        mine = [s for s in g["bifolia"] if s in sheets]
        if not mine:
            continue
        at = next((i for i, x in enumerate(out["gatherings"]) if str(x["quire"]) == str(g["quire"])), None)
        if at is None:
            out = _lift(out, mine)
            out["gatherings"].insert(min(k, len(out["gatherings"])), dict(g, bifolia=mine))
            continue
        for s in mine:
            later = set(g["bifolia"][g["bifolia"].index(s) + 1 :])
            row = [x for x in out["gatherings"][at]["bifolia"] if x != s]
            put = next((i for i, x in enumerate(row) if x in later), len(row))
            out = _lift(out, [s])
            out["gatherings"][at]["bifolia"].insert(put, s)
    return _tidy(_copy(out), book)


def name_clash(book: dict, name: str, but: int | None = None) -> bool:
    return any(str(g["quire"]).lower() == name.lower() for k, g in enumerate(book["gatherings"]) if k != but)


def free_name(book: dict) -> str:
    k = 1
    while name_clash(book, f"New {k}"):
        k += 1
    return f"New {k}"


def describe_gathering(bifolia: list[str], section: dict[str, str], home: dict[str, str]) -> dict:
    """A gathering's commonest section and home quire (first seen of equals), and the sheets from elsewhere."""
    def common(values):
        seen = Counter(values)
        return max(seen, key=lambda v: (seen[v], -list(seen).index(v))) if seen else None

    quire = common([home[s] for s in bifolia if s in home])
    return {"section": common([section[s] for s in bifolia if s in section]), "quire": quire, "extras": [s for s in bifolia if home.get(s) != quire]}


def changed_sheets(old: dict, new: dict) -> int:
    """How many sheets moved between two versions of an order: those outside the kept order of their gathering."""
    was = {s: (str(g["quire"]), i) for g in old["gatherings"] for i, s in enumerate(g["bifolia"])}
    n = 0
    for g in new["gatherings"]:
        stay = [s for s in g["bifolia"] if s in was and was[s][0] == str(g["quire"])]
        n += len(g["bifolia"]) - len(longest_rise([was[s][1] for s in stay]))
    return n


class History:
    """Undo and redo of one order: at most limit steps back; an edit drops what could be redone."""

    def __init__(self, book: dict, limit: int = 100):
        self.book, self.limit, self.past, self.future = book, limit, [], []

    def edit(self, changed: dict | None) -> bool:
        if changed is None:
            return False
        self.past = [*self.past, self.book][-self.limit :]
        self.book, self.future = changed, []
        return True

    def undo(self) -> bool:
        if self.past:
            self.future.append(self.book)
            self.book = self.past.pop()
            return True
        return False

    def redo(self) -> bool:
        if self.future:
            self.past.append(self.book)
            self.book = self.future.pop()
            return True
        return False


def keep_version(versions: list[dict], book: dict, most: int = 20) -> list[dict]:
    """versions (newest first) with book before them, unless it equals the newest; at most most."""
    return versions if versions and versions[0] == book else [book, *versions][:most]
