"""Work on words that is done many at a time, held against what it says word by word."""

import random

import numpy as np
import pyarrow as pa

from glyphmill.operators import boxes as B
from glyphmill.operators import shapes as H


def one_arc(fx, fy, r, t, x0, y0, x1, y1):
    """The best radius, ends and fit, all half degrees tried for every radius."""
    base = round(2 * np.degrees(np.arctan2((y0 + y1) / 2 - fy, (x0 + x1) / 2 - fx))) / 2
    m, best = H.MARGIN * t, (0, 0, 0, -1.0)
    for rr in r + np.linspace(-H.WANDER, H.WANDER, H.STEPS) * t:
        angles = base + np.arange(-360, 360) / 2
        px, py = fx + rr * np.cos(np.radians(angles)), fy + rr * np.sin(np.radians(angles))
        hit = (px >= x0 - m) & (px <= x1 + m) & (py >= y0 - m) & (py <= y1 + m)
        if not hit.any():
            continue
        k = min(np.flatnonzero(hit), key=lambda c: (abs(c - 360), c))
        a, b = k, k
        while a > 0 and hit[a - 1]:
            a -= 1
        while b < 719 and hit[b + 1]:
            b += 1
        a0, a1 = angles[a], angles[b]
        ends = np.radians([a0, a1, *(q for q in np.arange(-8, 9) * 90.0 if a0 < q < a1)])
        xs, ys = (np.concatenate([o + (rr - t / 2) * f(ends), o + (rr + t / 2) * f(ends)]) for o, f in ((fx, np.cos), (fy, np.sin)))
        both = max(0, min(x1, xs.max()) - max(x0, xs.min())) * max(0, min(y1, ys.max()) - max(y0, ys.min()))
        fit = both / max(1e-9, (x1 - x0) * (y1 - y0) + np.ptp(xs) * np.ptp(ys) - both)
        if fit > best[3]:
            best = (rr, a0, a1, fit)
    return best


def test_arcs_of_many_words_are_those_of_each():
    rng = np.random.default_rng(3)
    n = 300
    fx, fy, r, t, turn = rng.uniform(300, 600, n), rng.uniform(300, 600, n), rng.uniform(50, 320, n), rng.uniform(5, 30, n), np.radians(rng.uniform(0, 360, n))
    x, y = fx + r * np.cos(turn) + rng.normal(0, 4, n), fy + r * np.sin(turn) + rng.normal(0, 4, n)
    wide, high = (np.where(np.arange(n) % 10 == 0, 900.0, v) for v in (30.0, 24.0))  # some boxes hold the circle's centre
    at = (fx, fy, r, t, x - wide / 2, y - high / 2, x + wide / 2, y + high / 2)
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in at], ["fx", "fy", "fr", "t", "x0", "y0", "x1", "y1"])
    got = next(H._arcs(iter([batch]))).select(["rr", "a0", "a1", "fit"])
    got, want = np.array([c.to_numpy() for c in got.columns]).T, np.array([one_arc(*v) for v in zip(*at, strict=True)])
    fits = want[:, 3] >= H.ARC_FIT
    assert 100 < fits.sum() < n and ((got[:, 3] >= H.ARC_FIT) == fits).all() and np.allclose(got[fits], want[fits], atol=1e-9)
    reach = H._reach(*at)
    assert np.median(reach) < 60 and (reach == 360).sum() >= 5
    assert next(H._arcs(iter([batch.slice(0, 0)]))).num_rows == 0


def test_boxes_are_shared_out_without_a_table_for_each_span(monkeypatch):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        k = rng.randint(1, 4)
        rows.append(tuple(["".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(n)] for n in (rng.randint(k, k + 3), k)))
    for boxes, words in rows:
        far = lambda w, p, q, b=boxes: int(edits([w], ["".join(b[p:q])])[0, 0])
        least = lambda k, p, b=boxes, w=words: (0 if p == len(b) else 10**9) if k == len(w) else min((far(w[k], p, q) + least(k + 1, q) for q in range(p + 1, len(b) + 1)), default=10**9)  # noqa: B023, E731
        edits = B.edits
        with monkeypatch.context() as m:
            m.setattr(B, "edits", None)  # no arrays for a few letters
            sizes = B.shared_out(boxes, words)
        ends = np.cumsum([0, *sizes]).tolist()
        assert min(sizes) > 0 and ends[-1] == len(boxes)
        assert sum(far(w, p, q) for w, p, q in zip(words, ends, ends[1:], strict=False)) == least(0, 0)
