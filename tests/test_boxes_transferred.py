"""Boxes for another reading's words, many lines at once, against one line at a time without bins."""

import random

from glyphmill.functions.glyphs import glyph_map
from glyphmill.operators import boxes as B


def plain(own, own_word, shown, shown_word, boxes):
    at = glyph_map(shown, own)
    out = {}
    for of in set(own_word):
        mine = [a for a, w in zip(at, own_word, strict=True) if w == of]
        j0, j1, parts = min(mine), max(mine) + 1, []
        for word, panel, x, y, w, h, est in boxes:
            k = [i for i, v in enumerate(shown_word) if v == word]
            if k and max(k) + 1 > j0 and min(k) < j1:
                a, n = min(k), max(k) + 1 - min(k)
                f0, f1 = max(0.0, (j0 - a) / n), min(1.0, (j1 - a) / n)
                if f1 - f0 >= B.SLIVER:
                    parts.append((f0, f1, word, panel, x, y, w, h, est))
        if parts:
            many = {}
            for p in parts:
                many.setdefault(p[3], []).append(p[2])
            main = min(many, key=lambda p: (-len(many[p]), min(many[p]), p or ""))
            if main is None:
                continue
            kept = [p for p in parts if p[3] == main]
            whole = all(p[0] <= B.START and p[1] >= B.END for p in parts)
            flat = [(f0, f1, w >= h) for f0, f1, _, _, _, _, w, h, _ in kept]
            x0 = min(p[4] + (p[6] * f0 if f else 0) for p, (f0, _, f) in zip(kept, flat, strict=True))
            y0 = min(p[5] + (0 if f else p[7] * f0) for p, (f0, _, f) in zip(kept, flat, strict=True))
            x1 = max(p[4] + (p[6] * f1 if f else p[6]) for p, (_, f1, f) in zip(kept, flat, strict=True))
            y1 = max(p[5] + (p[7] if f else p[7] * f1) for p, (_, f1, f) in zip(kept, flat, strict=True))
            out[of] = (main, x0, y0, x1, y1, any(p[8] for p in kept) or not whole)
    return out


def test_boxes_of_random_lines(spark):
    rng, lines, boxes, want = random.Random(9), [], [], {}
    for line in range(120):
        shown = [(rng.choice("abcdefg"), w) for w in range(rng.choice((1, 3, 8, 60 if line % 30 == 0 else 5))) for _ in range(rng.randint(1, 4))]
        own, of = [], 0
        for g, _ in shown:
            of += rng.random() < 0.4
            own += [(g, of)] if rng.random() < 0.85 else []
            own += [("z", of)] if rng.random() < 0.1 else []
        row = [g for g, _ in own], [w for _, w in own], [g for g, _ in shown], [w for _, w in shown]
        mine = [(w, rng.choice("ab") if line % 5 else rng.choice(("a", None)), float(rng.randint(0, 90)), 5.0, float(rng.randint(1, 30)), float(rng.randint(1, 30)), rng.random() < 0.1) for w in {w for _, w in shown} if line % 7 and rng.random() < 0.9]
        lines.append((line, *row))
        boxes += [(line, *b) for b in mine] + [(line, 999, "a", 0.0, 0.0, 1.0, 1.0, False)]
        want |= {(line, w): told for w, told in plain(*row, mine).items()}
    told = B.transfer_by_glyphs(spark.createDataFrame(lines, "line long, own array<string>, own_word array<int>, shown array<string>, shown_word array<int>"), spark.createDataFrame(boxes, "line long, word int, panel string, x double, y double, w double, h double, est boolean"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    got = {(r.line, r.word): r for r in told.collect()}
    assert got.keys() == want.keys()
    for key, (panel, *sides, est) in want.items():
        r = got[key]
        assert (r.panel, r.est) == (panel, est) and all(abs(a - b) < 1e-9 for a, b in zip((r.x0, r.y0, r.x1, r.y1), sides, strict=True)), key
    # a line's glyphs and boxes meet once
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 1
    assert B.transfer_by_glyphs(spark.createDataFrame(lines, "line long, own array<string>, own_word array<int>, shown array<string>, shown_word array<int>").limit(0), spark.createDataFrame(boxes, "line long, word int, panel string, x double, y double, w double, h double, est boolean")).count() == 0
