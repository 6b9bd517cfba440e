"""The shapes that words of a page have: upright boxes, turned boxes along slanted lines and radii, arcs along rings.

A line's model is chosen by fits that are sums over its words (a circle, a principal axis), so lines are grouped, never
gathered; where a word's neighbours count, windows over its line look at them. Only the part of a circle that lies in a
word's box is a function of that word, over Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.shipping import ship, spread, stored
from glyphmill.operators.spatial import circle_fit, lower_third, wrapped

# Fixed values. A ring: words measured and placed on it, the miss of its radius, degrees it spans, its radius in text
# heights, how far and in how many steps a word's own radius may differ, margin in text heights, how well its arc must fit.
RING_WORDS, RING_PLACED, RING_MISS, RING_SPAN, RING_HEIGHTS = 4, 3, 0.12, 60.0, 3.0
WANDER, STEPS, MARGIN, ARC_FIT = 0.9, 13, 0.08, 0.45
# Radii and angles of words that are tried at a time.
ARC_CELLS = 200_000
# Between words: part of a glyph, degrees behind what is reached that count as another round, and the widest guess.
SPACE, BACK, WIDEST = 0.6, 30.0, 90.0
# A turned box: how well it must fill its own; a slanted line: words of a paragraph's and of a label's, its length in text
# heights, its width to its length, the least slant in degrees. A sliver: part of the text height.
TURN_FIT, SLANT_WORDS, SLANT_LABELS, SLANT_HEIGHTS, SLANT_WIDTH, SLANT_LEAST, SLIVER = 0.35, 3, 2, 3.0, 0.35, 8.0, 0.3


def _arcs(batches):
    """Each word's radius, ends and fit on its line's circle: the radius whose arc within the box fills the box best.

    Angles are tried by half degrees, around that of the box's middle; a radius's arc is the run of them within the box
    that holds the middle's, or is nearest to it. Of a box that doesn't hold the circle's centre, only the angles that it
    is seen under are tried.
    """
    import pyarrow as pa

    for batch in batches:
        at = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("fx", "fy", "fr", "t", "x0", "y0", "x1", "y1")]
        told = np.zeros((batch.num_rows, 4))
        reach = _reach(*at)
        order = np.argsort(reach, kind="stable")
        first = 0
        while first < len(order):  # words whose boxes reach about as far go together
            some = order[first : first + max(1, ARC_CELLS // (STEPS * (2 * int(reach[order[first]]) + 1)))]
            some = some[reach[some] <= 2 * reach[some[0]]]
            told[some] = _best_arcs(*(x[some] for x in at), int(reach[some[-1]]))
            first += len(some)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, told.T.copy())], [*batch.schema.names, "rr", "a0", "a1", "fit"])


def _middle(fx, fy, x0, y0, x1, y1) -> np.ndarray:
    """The angle of each box's middle, to half a degree."""
    return np.round(2 * np.degrees(np.arctan2((y0 + y1) / 2 - fy, (x0 + x1) / 2 - fx))) / 2


def _reach(fx, fy, r, t, x0, y0, x1, y1) -> np.ndarray:
    """How many half degrees from its middle each box with its margin may reach, seen from the circle's centre: all 360 if that lies in it."""
    m, base = MARGIN * t, _middle(fx, fy, x0, y0, x1, y1)
    corners = np.stack([np.degrees(np.arctan2(y - fy, x - fx)) - base for x in (x0 - m, x1 + m) for y in (y0 - m, y1 + m)])
    far = np.ceil(2 * np.abs((corners + 180) % 360 - 180).max(axis=0)) + 2
    apart = (fx < x0 - m) | (fx > x1 + m) | (fy < y0 - m) | (fy > y1 + m)
    return np.where(apart & (far < 350), far, 360).astype(np.int64)


def _best_arcs(fx, fy, r, t, x0, y0, x1, y1, reach: int) -> np.ndarray:
    """Radius, ends and fit of some words' arcs; angles further than reach half degrees from a box's middle are in none of the boxes."""
    turn = np.arange(-360, 360) if reach >= 360 else np.arange(-reach, reach + 1)
    cols, quarter = np.arange(len(turn)), np.arange(-8, 9) * 90.0
    angle = _middle(fx, fy, x0, y0, x1, y1)[:, None] + turn / 2
    rr = r[:, None] + np.linspace(-WANDER, WANDER, STEPS) * t[:, None]
    fx, fy, t, x0, y0, x1, y1 = (v[:, None] for v in (fx, fy, t, x0, y0, x1, y1))
    m = (MARGIN * t)[:, :, None]
    px, py = (o[:, :, None] + rr[:, :, None] * f(np.radians(angle))[:, None, :] for o, f in ((fx, np.cos), (fy, np.sin)))
    inside = (px >= x0[:, :, None] - m) & (px <= x1[:, :, None] + m) & (py >= y0[:, :, None] - m) & (py <= y1[:, :, None] + m)
    k = np.where(inside, np.abs(turn), 720).argmin(axis=2)[:, :, None]
    last = np.where(~inside & (cols > k), cols, len(cols)).min(axis=2) - 1
    first = np.where(~inside & (cols < k), cols, -1).max(axis=2) + 1
    a0, a1 = (np.take_along_axis(angle, n, 1)[:, :, None] for n in (first, last))
    # the box around the ring's part between these angles
    ends = np.concatenate([a0, a1, np.where((quarter > a0) & (quarter < a1), quarter, a0)], axis=2)
    low, high = (rr - t / 2)[:, :, None], (rr + t / 2)[:, :, None]
    xs, ys = (np.concatenate([o[:, :, None] + low * f, o[:, :, None] + high * f], axis=2) for o, f in ((fx, np.cos(np.radians(ends))), (fy, np.sin(np.radians(ends)))))
    across = np.minimum(x1, xs.max(axis=2)) - np.maximum(x0, xs.min(axis=2))
    down = np.minimum(y1, ys.max(axis=2)) - np.maximum(y0, ys.min(axis=2))
    both = np.maximum(0, across) * np.maximum(0, down)
    fit = both / np.maximum(1e-9, (x1 - x0) * (y1 - y0) + np.ptp(xs, axis=2) * np.ptp(ys, axis=2) - both)
    fit[~inside.any(axis=2)] = -1
    n = fit.argmax(axis=1)[:, None]
    return np.concatenate([np.take_along_axis(v, n, 1) for v in (rr, a0[:, :, 0], a1[:, :, 0], fit)], axis=1)


def _turned(w: Column, h: Column, angle: Column, t: Column) -> tuple[Column, Column]:
    """Length of a box of height t turned by angle within an upright one of w by h, and how much of their joint area they share."""
    dx, dy = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    half = F.least(F.when(dx > 1e-6, w / 2 / dx), F.when(dy > 1e-6, h / 2 / dy))
    length = F.greatest(2 * half - t * 0.5, t)
    bw, bh = length * dx + t * dy, length * dy + t * dx
    both = F.least(w, bw) * F.least(h, bh)
    return length, both / F.greatest(F.lit(1e-9), w * h + bw * bh - both)


def rings(words: DataFrame) -> DataFrame:
    """page, line, fx, fy, fr, t, sense: the circles of ring lines (kind C) whose measured words lie on one; sense is 1 if they run clockwise.

    words(page, line, word, kind, cx, cy, w, h, est, t_all) with a centre each.
    """
    sure = words.filter("kind = 'C' and not est").withColumn("at", F.struct("page", "line"))
    fit = circle_fit(sure.select("at", F.col("cx").alias("x"), F.col("cy").alias("y")), "at").select("at", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("r").alias("fr"))
    told = sure.join(fit.filter("fr is not null"), "at")
    angle = F.degrees(F.atan2(F.col("cy") - F.col("fy"), F.col("cx") - F.col("fx")))
    told = told.withColumn("angle", angle)
    by_angle, whole = Window.partitionBy("at").orderBy("angle", "word"), Window.partitionBy("at")
    told = told.withColumn("gap", F.coalesce(F.lead("angle").over(by_angle), F.min("angle").over(whole) + 360) - F.col("angle"))
    told = told.withColumn("step", wrapped(F.lead("angle").over(Window.partitionBy("at").orderBy("word")) - F.col("angle")))
    miss = F.sqrt(F.avg((F.hypot(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy")) - F.col("fr")) ** 2))
    one = told.groupBy("at", "fx", "fy", "fr").agg(
        F.count("*").alias("n"), miss.alias("miss"), F.max("gap").alias("gap"), F.median("step").alias("step"), lower_third(F.collect_list(F.least("w", "h"))).alias("t"), F.first("t_all").alias("t_all")
    )
    good = (F.col("n") >= RING_WORDS) & (F.col("miss") <= RING_MISS * F.col("fr")) & (360 - F.col("gap") >= RING_SPAN) & (F.col("fr") >= RING_HEIGHTS * F.col("t_all"))
    return one.filter(good).select("at.page", "at.line", "fx", "fy", "fr", "t", F.when(F.col("step") >= 0, 1).otherwise(-1).alias("sense"))


def arcs(words: DataFrame, circles: DataFrame, frame: tuple[float, float]) -> DataFrame:
    """page, line, word, p, angle, guessed: the words of ring lines as arcs (cx, cy, r0, r1, a0, a1).

    Measured words take the arc that fills their box; the others stand between them in proportion to their glyphs, or
    beyond them at the ring's own spacing, within the frame.
    """
    ship(words.sparkSession)
    line = words.filter("kind = 'C'").join(circles, ["page", "line"])
    sure = line.filter("not est and x0 is not null")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sure.schema.fields)
    fitted = spread(sure).mapInArrow(_arcs, kind + ", rr double, a0 double, a1 double, fit double").filter(F.col("fit") >= ARC_FIT)
    low, high = F.when(F.col("sense") > 0, F.col("a0")).otherwise(-F.col("a1")), F.when(F.col("sense") > 0, F.col("a1")).otherwise(-F.col("a0"))
    per = fitted.withColumns({"lo": low, "hi": high}).groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("word", "rr", "lo", "hi", "glyphs"))).alias("k"))
    per = per.filter(F.size("k") >= RING_PLACED)

    def put(state: Column, x: Column) -> Column:
        """Along the reading direction, unrolled from the first word."""
        base = state["ref"] + F.pmod(x["lo"] - state["ref"], F.lit(360.0))
        base = F.when(base < state["most"] - BACK, base + 360).otherwise(base)
        end = base + x["hi"] - x["lo"]
        return F.struct(state["ref"].alias("ref"), F.greatest(state["most"], end).alias("most"), F.concat(state["out"], F.array(F.struct(x["word"].alias("word"), x["rr"].alias("rr"), base.alias("s0"), end.alias("s1"), x["glyphs"].alias("glyphs")))).alias("out"))

    none = F.array().cast("array<struct<word:int,rr:double,s0:double,s1:double,glyphs:int>>")
    per = per.withColumn("u", F.aggregate("k", F.struct(F.get("k", F.lit(0))["lo"].alias("ref"), F.lit(-1e9).alias("most"), none.alias("out")), put)["out"])
    per = per.select("page", "line", "u", F.aggregate(F.array_sort(F.transform("u", lambda x: (x["s1"] - x["s0"]) / F.greatest(F.lit(1), x["glyphs"]))), F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x))).alias("g"))
    n = F.size("g")
    per = per.withColumn("pg", (F.get("g", F.floor((n - 1) / 2).cast("int")) + F.get("g", F.floor(n / 2).cast("int"))) / 2).drop("g")
    known = per.select("page", "line", F.explode("u").alias("u")).select("page", "line", F.col("u.word").alias("word"), F.struct("u.word", "u.rr", "u.s0", "u.s1").alias("u"))

    told = line.join(per.select("page", "line", "pg"), ["page", "line"]).join(known, ["page", "line", "word"], "left")
    by = Window.partitionBy("page", "line").orderBy("word")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    told = told.withColumn("upto", F.coalesce(F.sum("glyphs").over(before), F.lit(0))).withColumn("no", F.row_number().over(by))
    here = F.when(F.col("u").isNotNull(), F.struct("u", "upto", "no", "glyphs"))
    told = told.withColumn("p", F.last(here, True).over(before)).withColumn("q", F.first(here, True).over(after))
    pg, gap, g = F.col("pg"), SPACE * F.col("pg"), F.col("glyphs")
    # glyphs and words since the known word before, and until the one after
    g_since, n_since = F.col("upto") - F.col("p.upto") - F.col("p.glyphs"), F.col("no") - F.col("p.no") - 1
    g_until, n_until = F.col("q.upto") - F.col("upto") - g, F.col("q.no") - F.col("no") - 1
    start, end = F.col("p.u.s1") + gap / 2, F.col("q.u.s0") - gap / 2
    total = g_since + g + g_until + SPACE * (n_since + 1 + n_until)
    f0 = (g_since + SPACE * n_since) / total
    only_after = F.col("q.u.s0") - gap - g_until * pg - n_until * gap
    only_before = F.col("p.u.s1") + gap + g_since * pg + n_since * gap
    both, p_only = F.col("p").isNotNull() & F.col("q").isNotNull(), F.col("p").isNotNull()
    s0 = F.when(both, F.when(end > start, start + (end - start) * f0)).when(p_only, only_before).otherwise(only_after - g * pg)
    s1 = F.when(both, start + (end - start) * (f0 + g / total)).when(p_only, only_before + g * pg).otherwise(only_after)
    rr = F.when(both, (F.col("p.u.rr") + F.col("q.u.rr")) / 2).when(p_only, F.col("p.u.rr")).otherwise(F.col("q.u.rr"))
    # as rows of one element, so that what is built on it doesn't repeat the expressions
    span = F.struct(F.coalesce("u.s0", s0).alias("s0"), F.coalesce("u.s1", s1).alias("s1"), F.coalesce("u.rr", rr).alias("rr"))
    told = told.select("page", "line", "word", "fx", "fy", "t", "sense", F.col("u").isNull().alias("guessed"), F.inline(F.array(span))).filter("s0 is not null")
    a0, a1 = F.when(F.col("sense") > 0, F.col("s0")).otherwise(-F.col("s1")), F.when(F.col("sense") > 0, F.col("s1")).otherwise(-F.col("s0"))
    told = told.withColumns({"a0": a0, "a1": a1})
    mid = (F.col("a0") + F.col("a1")) / 2
    x, y = F.col("fx") + F.col("rr") * F.cos(F.radians(mid)), F.col("fy") + F.col("rr") * F.sin(F.radians(mid))
    fits = ~F.col("guessed") | (x.between(0, frame[0]) & y.between(0, frame[1]) & (F.col("s1") - F.col("s0") <= WIDEST))
    p = F.array("fx", "fy", F.col("rr") - F.col("t") / 2, F.col("rr") + F.col("t") / 2, "a0", "a1")
    return told.filter(fits).select("page", "line", "word", p.alias("p"), wrapped(mid + 90 * F.col("sense")).alias("angle"), "guessed")


def shapes(boxes: DataFrame, frame: tuple[float, float] = (1000.0, 1000.0)) -> DataFrame:
    """page, line, word, shape, p, angle, est of boxes(page, line, kind, word, glyphs, x0, y0, x1, y1, est).

    A word without a box has nulls; kind is the line's: P paragraph, L label, C ring, R radius. shape is r (x y w h), o
    (cx cy length thickness) turned by angle, or a (cx cy r0 r1 a0 a1). Words that get no place are left out.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    words = boxes.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "w": w, "h": h, "est": F.coalesce("est", F.lit(False))})
    size = F.least("w", "h")
    heights = words.filter("x0 is not null").groupBy("page").agg(lower_third(F.collect_list(size)).alias("t_all"), F.collect_list(F.when(F.col("kind") == "P", size)).alias("ps"))
    heights = heights.select("page", "t_all", F.when(F.size("ps") > 5, lower_third(F.col("ps"))).otherwise(F.col("t_all")).alias("t_line"))
    # both are read several times: written once, in the folder that all machines share
    words = stored(words.join(heights, "page"), "words")
    boxed = words.filter("x0 is not null")
    circles = stored(rings(boxed), "circles")
    round_ = arcs(words, circles, frame).select("page", "line", "word", F.lit("a").alias("shape"), "p", "angle", "guessed")

    by = Window.partitionBy("page", "line").orderBy("word")
    near = lambda c, f: F.coalesce(f(c).over(by), F.col(c))
    radii = boxed.filter("kind = 'R'").withColumn("many", F.count("*").over(Window.partitionBy("page", "line")))
    along = F.degrees(F.atan2(near("cy", F.lead) - near("cy", F.lag), near("cx", F.lead) - near("cx", F.lag)))
    radii = radii.withColumn("angle", F.when(F.col("many") > 1, along))
    # a radius of one word reads out from the nearest ring's centre
    out = radii.filter("many = 1").drop("angle").join(circles.select("page", "fx", "fy"), "page")
    far = F.hypot(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy"))
    out = out.groupBy("page", "line", "word").agg(F.min_by(F.degrees(F.atan2(F.col("cy") - F.col("fy"), F.col("cx") - F.col("fx"))), F.struct(far, "fx", "fy")).alias("out"))
    radii = radii.join(out, ["page", "line", "word"], "left").withColumn("angle", F.coalesce("angle", "out")).drop("out", "many").filter("angle is not null")
    length, fit = _turned(F.col("w"), F.col("h"), F.col("angle"), F.col("t_line"))
    radii = radii.withColumns({"length": length, "fit": fit}).filter(F.col("fit") >= TURN_FIT)

    flat = boxed.filter("kind in ('P', 'L')")
    n = F.count("*")
    sums = flat.groupBy("page", "line").agg(
        n.alias("n"), F.first("kind").alias("k"), (F.var_samp("cx") * (n - 1)).alias("sxx"), (F.var_samp("cy") * (n - 1)).alias("syy"), (F.covar_samp("cx", "cy") * (n - 1)).alias("sxy"),
        F.min_by(F.struct("cx", "cy"), "word").alias("a"), F.max_by(F.struct("cx", "cy"), "word").alias("b"), F.first("t_line").alias("tl"),
    )
    sums = sums.filter((F.col("n") >= F.when(F.col("k") == "P", SLANT_WORDS).otherwise(SLANT_LABELS)))
    half, mean = F.sqrt(((F.col("sxx") - F.col("syy")) / 2) ** 2 + F.col("sxy") ** 2), (F.col("sxx") + F.col("syy")) / 2
    axis = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    forth = (F.col("b.cx") - F.col("a.cx")) * F.cos(axis) + (F.col("b.cy") - F.col("a.cy")) * F.sin(axis) >= 0
    angle = wrapped(F.degrees(axis) + F.when(forth, 0).otherwise(180))
    long_, wide = F.sqrt(mean + half), F.sqrt(F.greatest(F.lit(0.0), mean - half))
    slanted = sums.withColumn("angle", angle).filter((long_ >= SLANT_HEIGHTS * F.col("tl")) & (wide <= SLANT_WIDTH * long_) & (F.abs("angle") >= SLANT_LEAST))
    flat = flat.join(slanted.select("page", "line", "angle"), ["page", "line"])
    flat = flat.withColumn("length", _turned(F.col("w"), F.col("h"), F.col("angle"), F.col("t_line"))[0])

    turned = [d.select("page", "line", "word", F.lit("o").alias("shape"), F.array("cx", "cy", "length", "t_line").alias("p"), "angle", F.lit(False).alias("guessed")) for d in (radii, flat)]
    made = round_.unionByName(turned[0]).unionByName(turned[1])
    told = words.join(made, ["page", "line", "word"], "left").filter("shape is not null or x0 is not null")
    sliver = F.col("shape").isNull() & (F.least("w", "h") < SLIVER * F.col("t_line"))
    wide = F.when(sliver, F.greatest(F.col("w"), 0.5 * F.col("t_line") * F.greatest(F.lit(1), F.col("glyphs")))).otherwise(F.col("w"))
    high = F.when(sliver, F.col("t_line")).otherwise(F.col("h"))
    plain = F.array(F.col("cx") - wide / 2, F.col("cy") - high / 2, wide, high)
    est = F.coalesce("guessed", F.lit(False)) | F.coalesce(sliver, F.lit(False)) | (F.col("est") & (F.coalesce("shape", F.lit("r")) != "a"))
    return told.select("page", "line", "word", F.coalesce("shape", F.lit("r")).alias("shape"), F.coalesce("p", plain).alias("p"), F.coalesce("angle", F.lit(0.0)).alias("angle"), est.alias("est"))
