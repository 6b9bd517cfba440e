"""The token side of the engine: finding words, contexts, page similarity, expected meetings, repeats, shared runs.

Works on tokens(page, num, kind, ps, wi, s, start, first, last, on). A view that needs the order of the whole text
numbers tokens with `numbered`, whose window is one page; `on` says whether the next token follows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.grouped import slices
from glyphmill.functions.shipping import ship
from glyphmill.plans.language import FAMILIES
from glyphmill.sources.corpus import numbered_by


def numbered(tokens: DataFrame) -> DataFrame:
    """tokens with i, the place in its page."""
    return tokens.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("num", "wi")))


def finder(mode: str, text: str) -> Column:
    """Whether word s is found: begins, whole, contains, or by wildcards * and ?."""
    word = F.col("s")
    if mode == "wild":
        body = "".join("[a-z]*" if c == "*" else "(?:c[ktpf]h|[cs]h|[a-z])" if c == "?" else c for c in text)
        return word.rlike(f"^{body}$")
    return {"begins": word.startswith(text), "whole": word == text, "contains": word.contains(text)}[mode]


def found_words(tokens: DataFrame, mode: str, text: str) -> DataFrame:
    """s, n, row: words found with their counts, the exact one first, then by count."""
    hit = tokens.filter(finder(mode, text)).groupBy("s").agg(F.count("*").alias("n"))
    return numbered_by(hit, "row", F.col("s") != text, -F.col("n"), "s")


def phrase(tokens: DataFrame, *words: str) -> DataFrame:
    """First tokens of every run of words, over line ends where the text runs on."""
    w = Window.partitionBy("page").orderBy("num", "wi")
    fit = [F.col("s") == words[0]]
    for k, x in enumerate(words[1:], 1):
        fit.append((F.lead("s", k).over(w) == x) & (F.lead("on", k - 1).over(w) if k > 1 else F.col("on")))
    return tokens.withColumn("_fit", reduce(lambda a, b: a & b, fit)).filter("_fit").drop("_fit")


def joined_words(lines: DataFrame) -> DataFrame:
    """page, num, wi, s: words on both sides of an uncertain space as one, at the first one's place."""
    ship(lines.sparkSession)

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (some for whole in batches for some in slices(whole, "line")):
            sure = pc.split_pattern(batch.column("line"), ".")
            parts = pc.split_pattern(pc.list_flatten(sure), ",")
            piece, s = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
            row = pc.list_parent_indices(sure).to_numpy()[piece]
            # words of one piece have uncertain spaces between them
            at = np.flatnonzero(piece[1:] == piece[:-1])
            wi = (at - np.searchsorted(row, row[at])).astype(np.int32)
            told, first = pa.array(row[at].astype(np.int64)), pa.array(at, pa.int64())
            both = pc.binary_join_element_wise(s.take(first), s.take(pc.add(first, 1)), "")
            yield pa.RecordBatch.from_arrays([batch.column("page").take(told), batch.column("num").take(told), pa.array(wi), both], ["page", "num", "wi", "s"])

    kind = lambda c: lines.schema[c].dataType.simpleString()
    return lines.filter("line <> ''").select("page", "num", "line").mapInArrow(scan, f"page {kind('page')}, num {kind('num')}, wi int, s string")


def context(tokens: DataFrame, hit: Column, reach: int) -> DataFrame:
    """Hits with up to reach words before and after, as far as the text runs on."""
    w = Window.partitionBy("page").orderBy("num", "wi")
    before, after = [], []
    ok_b, ok_a = F.lit(True), F.col("on")
    for k in range(1, reach + 1):
        ok_b = ok_b & F.coalesce(F.lag("on", k).over(w), F.lit(False))
        before.insert(0, F.when(ok_b, F.lag("s", k).over(w)))
        after.append(F.when(ok_a, F.lead("s", k).over(w)))
        ok_a = ok_a & F.coalesce(F.lead("on", k).over(w), F.lit(False))
    told = tokens.select("page", "num", "wi", "s", hit.alias("_hit"), F.concat_ws(" ", *before).alias("before"), F.concat_ws(" ", *after).alias("after"))
    return told.filter("_hit").drop("_hit")


def context_in_lines(lines: DataFrame, hit: Callable[[Column], Column], reach: int) -> DataFrame:
    """context of tokens(lines) at words that hit holds for: page, num, wi, s, before, after.

    Lines meet the ends of the lines around them, and only lines with a hit are cut into words.
    """
    w = Window.partitionBy("page").orderBy("num")
    pieces = F.split("line", "[.,]")
    some = lines.filter("line <> ''").select(
        "page", "num", "kind", "ps", F.slice(pieces, 1, reach).alias("head"), F.reverse(F.slice(F.reverse(pieces), 1, reach)).alias("tail"), F.when(F.exists(pieces, hit), F.col("line")).alias("held")
    )
    some = some.withColumn("on", F.coalesce((F.col("kind") == "P") & (F.lead("kind").over(w) == "P") & ~F.lead("ps").over(w), F.lit(False)))
    none = F.array().cast("array<string>")
    before, after = none, none
    for k in range(reach, 0, -1):
        before = F.when(F.lag("on", k).over(w), F.concat(before, F.lag("tail", k).over(w))).otherwise(none)
        after = F.when(F.col("on") if k == 1 else F.lead("on", k - 1).over(w), F.concat(F.lead("head", k).over(w), after)).otherwise(none)
    told = some.select("page", "num", "held", before.alias("b"), after.alias("a")).filter("held is not null")
    words = F.split("held", "[.,]")
    told = told.select("page", "num", F.size("b").alias("n"), F.concat("b", words, "a").alias("all"), F.posexplode(words).alias("wi", "s")).filter(hit(F.col("s")))
    at = F.col("n") + F.col("wi")
    joined = lambda first, many: F.array_join(F.slice("all", first, many), " ")
    return told.select("page", "num", "wi", "s", joined(F.greatest(F.lit(1), at - reach + 1), F.least(at, F.lit(reach))).alias("before"), joined(at + 2, F.lit(reach)).alias("after"))


def phrase_in_lines(lines: DataFrame, *words: str) -> DataFrame:
    """page, num, wi of phrase in tokens(lines); only lines with the first word are cut into words."""
    told = context_in_lines(lines, lambda s: s == words[0], max(1, len(words) - 1))
    return told.filter((F.col("after") == " ".join(words[1:])) if len(words) > 1 else F.lit(True)).select("page", "num", "wi")


def ordered_places(told: DataFrame, by: str) -> DataFrame:
    """context rows numbered by the word before or after; rows without one last."""
    near = F.element_at(F.split("before", " "), -1) if by == "before" else F.element_at(F.split("after", " "), 1)
    key = F.when(near == "", "~").otherwise(near)
    return numbered_by(told, "row", key, "page", "num", "wi")


def where_it_sits(tokens: DataFrame, hit: Column, facts: DataFrame | None = None) -> DataFrame:
    """Counts of hits by place: first, last and inside for paragraph lines only, and by kind; with facts, by language and section."""
    p = F.col("kind") == "P"
    counts = {
        "places": F.lit(True),
        "first": p & F.col("first"),
        "last": p & F.col("last"),
        "inside": p & ~F.col("first") & ~F.col("last"),
        "elsewhere": ~p,
        **{f"kind_{k.lower()}": F.col("kind") == k for k in ("P", "L", "C", "R")},
    }
    hits = tokens.filter(hit)
    if facts is not None:
        hits = hits.join(facts.select("page", F.col("lang").alias("_lang"), F.col("section").alias("_section")), "page", "left")
        counts |= {"lang_a": F.col("_lang") == "A", "lang_b": F.col("_lang") == "B", "section_good": F.col("_section") == "good", "section_poor": F.col("_section") == "poor"}
    return hits.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()))


#: So many words are sent to every task.
FEW_WORDS = 100_000


def few(words: DataFrame) -> bool:
    """Whether these words can be sent to every task."""
    return words.limit(FEW_WORDS + 1).count() <= FEW_WORDS


def weights(tokens: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """s, tf, df, idf: occurrences, pages, and log of pages over df; with only(s), of these words, which go to every task."""
    some = tokens if only is None else tokens.join(F.broadcast(only), "s", "left_semi")  # behind a count
    held = some.groupBy("page", "s").agg(F.count("*").alias("n"))
    pages = tokens.select("page").distinct().agg(F.count("*").alias("pages"))
    each = held.groupBy("s").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    return each.join(F.broadcast(pages)).select("s", "tf", "df", F.log(F.col("pages") / F.greatest(F.col("df"), F.lit(1))).alias("idf"))  # one row


def pages_with(tokens: DataFrame, words: DataFrame, idf: DataFrame, near: bool = False) -> DataFrame:
    """page, n, score, weight: how many of words(w) a page holds, and the sum of their idf; a near spelling counts half.

    Near spellings are one edit apart. They are found by joining on spellings with one letter left out. Without them, few
    words go to the pages, so that only what meets them is shuffled.
    """
    exact = words.select("w", F.col("w").alias("s"), F.lit(1.0).alias("share"))
    if not near and few(words):
        held = tokens.select("page", "s").join(F.broadcast(exact), "s")  # behind a count
    else:
        held = None
    if near:
        exact = exact.unionByName(near_spellings(words, tokens.select("s").distinct()).select("w", "s", F.lit(0.5).alias("share")))
    held = tokens.select("page", "s").distinct().join(exact, "s") if held is None else held
    held = held.groupBy("page", "w").agg(F.max("share").alias("share"))
    scored = held.join(idf.select(F.col("s").alias("w"), "idf"), "w", "left").groupBy("page").agg(F.count("*").alias("n"), F.sum(F.col("share") * F.coalesce("idf", F.lit(0.0))).alias("score"))
    return scored.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))


def near_spellings(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(w, s) one edit apart: an equi-join on the word itself and its forms with one letter left out, then checked."""

    def forms(c: str) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return F.explode(F.array_distinct(F.concat(F.array(c), cut)))

    a, b = words.filter("w <> ''").select("w", forms("w").alias("form")), vocabulary.filter("s <> ''").select("s", forms("s").alias("form"))
    return a.join(b, "form").select("w", "s").distinct().filter(F.levenshtein("w", "s", 1) == 1)


def expected_pages(tokens: DataFrame, words: list[str]) -> DataFrame:
    """How many pages would hold all of words if words fell anywhere: the sum over pages of the product of chances."""
    size = tokens.groupBy("page").agg(F.count("*").alias("n"))
    tf = tokens.filter(F.col("s").isin(words)).groupBy("s").agg(F.count("*").alias("tf"))
    whole = tokens.agg(F.count("*").alias("all"))
    chance = size.crossJoin(F.broadcast(tf)).crossJoin(F.broadcast(whole))  # at most one row for each word asked
    each = chance.groupBy("page").agg(F.product(1 - F.pow(1 - F.col("tf") / F.col("all"), F.col("n"))).alias("p"))
    return each.agg(F.sum("p").alias("expected"))


def similar_pages(tokens: DataFrame, page, top: int = 10) -> DataFrame:
    """The pages that share most with page, by summed idf; words on more than half of all pages weigh little by idf."""
    words = tokens.filter(F.col("page") == page).select(F.col("s").alias("w")).distinct()
    idf = weights(tokens, words.withColumnRenamed("w", "s") if few(words) else None)
    told = pages_with(tokens.filter(F.col("page") != page), words, idf)
    return told.orderBy(F.col("score").desc(), F.col("n").desc(), "page").limit(top)


def shared_words(tokens: DataFrame, a, b, top: int = 8) -> DataFrame:
    """The rarest words two pages share."""
    both = tokens.filter(F.col("page").isin(a, b)).groupBy("s").agg(F.count_distinct("page").alias("n")).filter("n = 2").select("s")
    return weights(tokens).join(both, "s").orderBy("df", "s").limit(top).select("s", "df")


def repeats(lines: DataFrame) -> DataFrame:
    """page, num, a, b, n: arcs from a word to its next occurrence in the line, and how many words repeat from there on.

    An arc inside a longer one of the same stride is left out: only the first word of each diagonal run stays. All lines
    of a slice are looked at together, by sorting its words.
    """
    ship(lines.sparkSession)

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (some for whole in batches for some in slices(whole, "line")):
            cut = pc.split_pattern_regex(batch.column("line"), "[.,]")
            row = pc.list_parent_indices(cut).to_numpy().astype(np.int64)
            wi = np.arange(len(row)) - np.searchsorted(row, row)
            word = pc.list_flatten(cut).dictionary_encode().indices.to_numpy()
            by = np.lexsort((wi, word, row))
            next_ = np.flatnonzero((row[by][1:] == row[by][:-1]) & (word[by][1:] == word[by][:-1]))
            row, a, stride = row[by[next_]], wi[by[next_]], wi[by[next_ + 1]] - wi[by[next_]]
            by = np.lexsort((a, stride, row))
            row, a, stride = row[by], a[by], stride[by]
            on = (row[1:] == row[:-1]) & (stride[1:] == stride[:-1]) & (a[1:] == a[:-1] + 1)
            head = np.flatnonzero(~np.concatenate([[False], on])[: len(row)])
            n = np.diff(np.append(head, len(row)))
            told = pa.array(row[head])
            cols = [pa.array(a[head], pa.int32()), pa.array((a + stride)[head], pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page").take(told), batch.column("num").take(told), *cols], ["page", "num", "a", "b", "n"])

    kind = lambda c: lines.schema[c].dataType.simpleString()
    return lines.filter("line <> ''").select("page", "num", "line").mapInArrow(scan, f"page {kind('page')}, num {kind('num')}, a int, b int, n bigint")


def shared_runs(lines: DataFrame, line: tuple, top: int = 12, reach: int = 10_000) -> DataFrame:
    """The longest runs that line (page, num) shares with other lines, over their line ends where the text runs on.

    The line's words (more than reach raise, since they are broadcast) meet equal words; matches that follow each other
    by one stride, without a break of the text, are a stretch. A line takes part in a stretch from its first word in it
    to the stretch's end. Three words count, or two of at least three letters whose idf adds up to 4; a line's best is
    its longest, then weightiest, then the one that begins first.

    Places and breaks are running sums over lines; only lines with one of the words are cut into words, and only words
    whose neighbour is met too go on.
    """
    here = (F.col("page") == line[0]) & (F.col("num") == line[1])
    pieces = F.split("line", "[.,]")
    some = lines.filter("line <> ''")
    asked = some.filter(here).select(pieces.alias("own"))
    if (asked.select(F.size("own")).first() or [0])[0] > reach:
        raise ValueError(f"this line has more than {reach} words")
    near = F.arrays_zip(F.col("own").alias("s"), F.concat(F.array(F.lit(None).cast("string")), "own").alias("b"), F.slice("own", 2, F.size("own")).alias("a"))
    own = asked.select(F.posexplode(near).alias("x", "o")).select("x", "o.s", F.col("o.b").alias("own_b"), F.col("o.a").alias("own_a")).filter("s is not null")
    w = Window.partitionBy("page").orderBy("num")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    met = some.join(F.broadcast(asked))  # one row
    text = met.select(
        "page", "num", "kind", "ps", F.size(pieces).alias("n"), F.get(pieces, F.lit(0)).alias("head"), F.element_at(pieces, -1).alias("tail"), F.when(F.arrays_overlap(pieces, "own"), F.col("line")).alias("held")
    )
    text = text.withColumn("on", F.coalesce((F.col("kind") == "P") & (F.lead("kind").over(w) == "P") & ~F.lead("ps").over(w), F.lit(False)))
    text = text.select(
        "page", "num", "held", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum((~F.col("on")).cast("int")).over(before), F.lit(0)).alias("broken"),
        F.when(F.lag("on").over(w), F.lag("tail").over(w)).alias("b"), F.when(F.col("on"), F.lead("head").over(w)).alias("a"),
    ).filter("held is not null")
    words = F.split("held", "[.,]")
    each = F.arrays_zip(words.alias("s"), F.concat(F.array("b"), words).alias("b"), F.concat(F.slice(words, 2, F.size(words)), F.array("a")).alias("a"))
    told = text.select("page", "num", "at", "broken", F.posexplode(each).alias("wi", "t")).select("page", "num", "wi", "broken", (F.col("at") + F.col("wi") + 1).alias("i"), "t.s", "t.b", "t.a")
    pages = some.select("page").distinct().agg(F.count("*").alias("pages"))
    df = met.select("page", F.explode(F.array_intersect(pieces, "own")).alias("s")).distinct().groupBy("s").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(pages)).select("s", F.log(F.col("pages") / F.col("df")).alias("idf"))  # a row for each of the line's words
    told = told.join(F.broadcast(own), "s").filter((F.col("b") == F.col("own_b")) | (F.col("a") == F.col("own_a"))).join(F.broadcast(idf), "s").withColumn("stride", F.col("i") - F.col("x"))
    told = told.select("page", "num", "broken", "stride", "i", "x", "wi", "idf", F.length("s").alias("size"))
    told = told.withColumn("stretch", F.col("i") - F.row_number().over(Window.partitionBy("page", "broken", "stride").orderBy("i")))
    stretch = ("page", "broken", "stride", "stretch")
    # from a word to the stretch's end, added up from the end
    on = Window.partitionBy(*stretch).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    told = told.select("page", "num", "x", "wi", F.row_number().over(Window.partitionBy(*stretch, "num").orderBy("i")).alias("nth"), F.count("*").over(on).alias("n"), F.round(F.sum("idf").over(on), 6).alias("weight"), F.min("size").over(on).alias("short"))
    told = told.filter((F.col("nth") == 1) & ~here & ((F.col("n") >= 3) | ((F.col("n") == 2) & (F.col("weight") >= 4) & (F.col("short") >= 3))))
    best = Window.partitionBy("page", "num").orderBy(F.desc("n"), F.desc("weight"), "x", "wi")
    told = told.withColumn("best", F.row_number().over(best)).filter("best = 1")
    return told.orderBy(F.desc("n"), F.desc("weight"), "page", "num").limit(top).select("page", "num", "x", "wi", "n", "weight")


def glyph_pairs(tokens: DataFrame, cover: float = 0.995) -> DataFrame:
    """pair, n, share: adjacent glyphs within words, commonest first, until cover of all is reached, with the one that reaches it."""
    at = F.sequence(F.lit(1), F.length("s") - 1)
    pairs = tokens.filter(F.length("s") > 1).select(F.explode(F.transform(at, lambda i: F.substring("s", i, F.lit(2)))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("n").desc(), "pair").rowsBetween(Window.unboundedPreceding, 0)
    told = pairs.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return told.filter(F.col("upto") - F.col("n") < cover * F.col("all")).select("pair", "n", (F.col("upto") / F.col("all")).alias("share"))


def weighted_median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """The first value whose cumulative weight reaches half."""
    w = Window.orderBy(value)
    told = rows.select(value, F.sum(weight).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(weight).over(Window.partitionBy()).alias("all"))
    return told.filter(2 * F.col("upto") >= F.col("all")).agg(F.min(value).alias("median"))


def changes(rows: DataFrame, value: str, order: str) -> DataFrame:
    """How often value changes along order; rows without one are passed over."""
    return rows.filter(F.col(value).isNotNull()).select((F.col(value) != F.lag(value).over(Window.orderBy(order))).alias("c")).agg(F.count_if("c").alias("changes"))


def runs(rows: DataFrame, value: str, order: str, within: list[str] | None = None) -> DataFrame:
    """Runs of equal value along order: value, from, to, n."""
    w = Window.partitionBy(*(within or [])).orderBy(order)
    new = (F.lag(value).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    told = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return told.groupBy(*(within or []), "_run", value).agg(F.min(order).alias("from"), F.max(order).alias("to"), F.count("*").alias("n")).drop("_run")


def mode_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The commonest value; of equals, the one seen first."""
    each = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return each.agg(F.max_by(value, F.struct(F.col("n"), -F.col("at"))).alias(value))


def page_ranges(pages: DataFrame, order: DataFrame) -> DataFrame:
    """The shortest ranges of places in order that cover pages: low, high, n."""
    at = numbered_by(order.join(pages.select("page").distinct(), "page", "left_semi"), "nth", "pos").withColumn("run", F.col("pos") - F.col("nth"))
    return at.groupBy("run").agg(F.min_by("page", "pos").alias("low"), F.max_by("page", "pos").alias("high"), F.count("*").alias("n")).drop("run")


def family_form(word: Column) -> Column:
    """word with every glyph turned into its family's first."""
    return F.translate(word, "".join(FAMILIES), "".join(f[0] * len(f) for f in FAMILIES))
