"""Sheets whose texts are compared together: the values are those of each sheet alone, and comparisons don't grow with sheets."""

import random

from glyphmill.functions.distances import likeness
from glyphmill.operators import sheets as T


def test_many_sheets_are_compared_at_once(monkeypatch):
    rng = random.Random(5)
    text = lambda letters: "".join(rng.choices(letters, k=rng.randint(0, 9)))
    groups = [([text(letters) for _ in range(rng.randint(0, 9))], [text(letters) for _ in range(rng.randint(0, 9))]) for letters in ("ab", "abc", "ab?*", "aé𝐭") * 10]
    calls = []
    points = T._points
    monkeypatch.setattr(T, "_points", lambda texts: calls.append(1) or points(texts))
    told = T.close_in(groups, 0.6)
    assert len(calls) == 2
    for rows, (a, b) in zip(told, groups, strict=True):
        want = [[(j, v) for j, y in enumerate(b) if (v := likeness(x, y)) >= 0.6] for x in a]
        assert [[(j, round(v, 9)) for j, v in row] for row in rows] == [[(j, round(v, 9)) for j, v in row] for row in want]
    # texts too long for a machine word, or too many at once, tell the same
    monkeypatch.setattr(T, "TOGETHER", 20)
    assert T.close_in(groups, 0.6) == told
    monkeypatch.setattr(T, "BITS", 4)
    assert T.close_in(groups, 0.6) == told
