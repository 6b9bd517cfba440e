"""Edit distances as columns, and the sequence measures that need Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.plans.language import family


def near_cost(text: Column, word: str) -> Column:
    """Edits from text to word, where a substitution inside a glyph family costs half.

    The distance table is walked row by row over the letters of text, as nested array folds in the JVM.
    """
    letters = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(c).alias("c"), F.lit(family(c)).alias("kin")) for j, c in enumerate(word)))

    def row(old: Column, letter: Column) -> Column:
        def cell(done: Column, p: Column) -> Column:
            sub = F.when(letter == p["c"], 0.0).when(p["kin"].contains(letter), 0.5).otherwise(1.0)
            return F.concat(done, F.array(F.least(F.get(old, p["j"] + 1) + 1.0, F.element_at(done, -1) + 1.0, F.get(old, p["j"]) + sub)))

        return F.aggregate(letters, F.array(F.get(old, F.lit(0)) + 1.0), cell)

    start = F.array(*(F.lit(float(j)) for j in range(len(word) + 1)))
    each = F.filter(F.split(text, ""), lambda x: x != "")
    return F.element_at(F.aggregate(each, start, row), -1)


def spelling_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance up to 1, and 2 for anything above."""
    d = F.levenshtein(a, b, 1)
    return F.when(d < 0, 2).otherwise(d)


def match_ladder(a: Column, b: Column) -> Column:
    """3 for equal words, 2 and 1 for near ones by share of edits, else -2."""
    share = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 3).when(share <= 0.2, 2).when(share <= 0.34, 1).otherwise(-2)


def likeness(a: str, b: str) -> float:
    """1 less the edits by the longer length, where ? and * cost half; empty texts are like nothing."""
    if not a or not b:
        return 0.0
    if a == b and not set(a) & set("?*"):
        return 1.0
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            sub = 0.5 if x in "?*" or y in "?*" else float(x != y)
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + sub))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def shared_glyphs(a: str, b: str) -> tuple[int, int]:
    """Glyphs in matching blocks, and the longer length."""
    from difflib import SequenceMatcher

    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), max(len(a), len(b))
