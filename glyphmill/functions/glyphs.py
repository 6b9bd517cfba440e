"""Glyph and text functions as columns: writing codes in an alphabet, typed queries, words, names of loci, dictionaries."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters one types with, longest first.
UNITS = ("ckh", "cth", "cph", "cfh", "ch", "sh", "o", "a", "y", "q", "d", "l", "m", "g", "r", "s", "i", "n", "e", "k", "t", "p", "f", "x", "v")
CODE = r"[A-Z][0-9a-z%]"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map().cast("map<string,string>")


def write_as(codes: Column, single: dict[str, str], double: dict[str, str]) -> Column:
    """A line's codes in an alphabet: a rule for two codes goes first, a code without a rule is ?."""
    pattern = "|".join([*map(re.escape, double), CODE])
    table = _map(single | double)
    return F.array_join(F.transform(F.regexp_extract_all(codes, F.lit(pattern), F.lit(0)), lambda x: F.coalesce(table[x], F.lit("?"))), "")


def as_glyphs(line: Column, glyph: dict[str, str]) -> Column:
    """Letters as a script's characters: a space for a word break, · for an uncertain one; what is no glyph stays."""
    table = _map({u: glyph[u] for u in UNITS if u in glyph} | {".": " ", ",": "·"})
    units = [re.escape(u) for u in UNITS if u in glyph]
    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit("(?s)" + "|".join([*units, "."])), F.lit(0)), lambda x: F.coalesce(table[x], x)), "")


def typed(text: str, letters: dict[str, str] | None = None) -> str:
    """What is typed, as a query: capitals lowered, glyph characters as letters, only letters and wildcards kept."""
    out = "".join((letters or {}).get(c, c.lower() if re.match("[A-Za-z*?]", c) else "") for c in text.strip())
    return re.sub(r"\*+", "*", out)


def line_words(line: Column, uncertain_is_space: bool = True) -> Column:
    return F.filter(F.split(F.replace(line, F.lit(","), F.lit("." if uncertain_is_space else "")), r"\."), lambda w: w != "")


def bare(line: Column) -> Column:
    """Glyphs only; a rare one as @."""
    return F.regexp_replace(F.regexp_replace(line, r"@\d{3};", "@"), "[.,]", "")


def page_of(locus: Column) -> Column:
    return F.regexp_extract(locus, r"^(.*)\.", 1)


def number_of(locus: Column) -> Column:
    return F.substring_index(locus, ".", -1)


def short_page(page: Column) -> Column:
    return F.regexp_replace(page, "^f", "")


def para_marks(text: Column) -> Column:
    return F.struct(F.contains(text, F.lit("<%>")).alias("start"), F.contains(text, F.lit("<$>")).alias("end"))


def named_parts(value: Column, names: dict[str, str]) -> Column:
    """A section made of parts with slashes, each by its name."""
    table = _map(names)
    return F.array_join(F.transform(F.split(value, "/"), lambda x: F.coalesce(table[F.btrim(x)], F.btrim(x))), " / ")


def code_words(line: Column, comma_splits: bool) -> Column:
    """(code, word) for each code of a line, its word counted from 0 over separators."""
    breaks = "[.,-]" if comma_splits else "[.-]"
    parts = F.split(line, breaks)
    return F.flatten(F.transform(parts, lambda p, i: F.transform(F.regexp_extract_all(p, F.lit(CODE), F.lit(0)), lambda c: F.struct(c.alias("code"), i.alias("word")))))


def glyph_map(shown: list[str], own: list[str]) -> list[float]:
    """For each glyph of own, its place in shown: in proportion inside an aligned stretch, between neighbours if only own has it."""
    out: list[float] = []
    for _, i0, i1, j0, j1 in SequenceMatcher(None, own, shown, autojunk=False).get_opcodes():
        out += [j0 + k * (j1 - j0) / (i1 - i0) if j1 > j0 else j0 - 0.5 for k in range(i1 - i0)]
    return out


def alphabet(used: set[str], rules: dict[str, str], letters: dict[str, str], basic: dict[str, str], like: dict[str, str] | None = None) -> dict:
    """How an alphabet writes the codes used: codes, multi (rules over two codes), approx (written by the nearest basic form) and search.

    letters maps codes to full letters, basic to basic ones; like names the letter that one is drawn like. search maps
    what the alphabet writes back to letters, so that a query can be typed in it.
    """
    plain = [(letters[c], rules[c]) for c in letters if c in rules and letters[c].isascii() and letters[c].isalpha() and letters[c].islower()]
    written = dict(reversed(plain))  # the first code of a letter counts
    units = re.compile("|".join(sorted(map(re.escape, written), key=len, reverse=True)) or "(?!)")
    drawn = str.maketrans({k: v for k, v in (like or {}).items() if len(k) == 1})

    def nearest(code: str) -> str:
        form = basic.get(code, "?")
        for way in (form, form.translate(drawn)):
            pieces = units.findall(way)
            if pieces and "".join(pieces) == way:
                return "".join(written[x] for x in pieces)
        return rules.get("Z1", "?")

    lacking = sorted(used - rules.keys())
    return {
        "codes": {c: rules[c] if c in rules else nearest(c) for c in sorted(used)},
        "multi": {k: v for k, v in rules.items() if len(k) > 2 and used.issuperset(re.findall(CODE, k))},
        "approx": lacking,
        "search": {rules[c]: letters[c] for c in sorted(used & rules.keys() & letters.keys(), reverse=True)},
    }


def alphabets(used: set[str], schemes: dict[str, dict[str, str]], letters: dict[str, str], basic: dict[str, str], like: dict[str, str] | None = None) -> dict[str, dict]:
    """alphabet for every scheme, by name."""
    return {name: alphabet(used, rules, letters, basic, like) for name, rules in schemes.items()}


def present_on(lines: DataFrame) -> DataFrame:
    """locus, n: how many witnesses have a line there."""
    return lines.groupBy("locus").agg(F.count_if(F.coalesce("text", F.lit("")) != "").alias("n"))


def facet_pages(facts: DataFrame, order: DataFrame, facet: str) -> DataFrame:
    """value and its pages in order, one string of pages for each value."""
    told = facts.join(order, "page").groupBy(facet).agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("p"))
    return told.select(F.col(facet).alias("value"), F.array_join(F.transform("p", lambda x: x["page"].cast("string")), " ").alias("pages"))


def distinct_facts(panels: DataFrame, group: str, facts: list[str]) -> DataFrame:
    """The distinct values of each fact over a group's panels, sorted."""
    return panels.groupBy(group).agg(*(F.array_join(F.array_sort(F.collect_set(F.col(f).cast("string"))), " ").alias(f) for f in facts))


def varied_examples(edits: DataFrame, most: int = 12, a_kind: int = 2) -> list:
    """Edits to show: the first of a page, at most a_kind of a kind, most in all, in order of ord.

    A choice depends on those before it, so it is made on the driver, from most * a_kind pages of each kind: an edit
    that is passed over stands behind a full kind or one of most pages that are taken.
    """
    on_page = F.row_number().over(Window.partitionBy("kind", "page").orderBy("ord"))
    of_kind = F.row_number().over(Window.partitionBy("kind").orderBy("ord"))
    first = edits.withColumn("on_page", on_page).filter("on_page = 1").withColumn("of_kind", of_kind).filter(F.col("of_kind") <= most * a_kind)
    shown: list = []
    for edit in first.select(*edits.columns).orderBy("ord").collect():  # most * a_kind rows of each kind
        like = [x for x in shown if x["page"] == edit["page"]] or [x for x in shown if x["kind"] == edit["kind"]][a_kind - 1 :]
        if not like and len(shown) < most:
            shown.append(edit)
    return shown


def within(spark: SparkSession, seconds: float, action):
    """action's result, or TimeoutError: its jobs are cancelled after so many seconds."""
    import threading
    import uuid

    sc, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "search", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"This search took more than {seconds:g} seconds; a simpler pattern will be quicker") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
