"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

All of it is DataFrame functions. Words and word pairs are hashed to SLOTS slots. The raw multinomial counts every
document, with ADD added to each slot; the target multinomial counts the documents of a bounded sample of trusted rows
(label quality 1, not toxic; TRUSTED rows of the smallest hashes), with PRIOR n-grams more that are spread as the raw
ones. So a slot that the sample says little of has a ratio near zero, a small sample moves scores towards zero, and one
limit, FLOOR, holds for tables of every size. A document's score is the mean over its n-grams of log(target / raw).

Base counts follow the contract: word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed holds for under 50
words, or if more than half of the words stand in 3-word windows found at least twice. Windows are told apart by 64-bit
hashes of their words, in one way for texts of every length.

Defined results: a null, empty or white-space text has no words and fails the base. Repeated rows give repeated rows.
Without trusted rows, both multinomials are level and the verdict is the base's. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SLOTS, ADD, PRIOR, TRUSTED = 16384, 1.0, 262_144.0, 20_000
#: The lowest score that is kept. On labelled rows of 1,000 and 10,000 documents it lies between all sound ones and all but one poor one.
FLOOR = -0.045


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spaced() -> Column:
    """The text with every white-space character turned into a blank."""
    out = F.coalesce("text", F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _words(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def _n_grams(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word with its slot and that of the pair it begins; the last word's pair is itself and nothing."""
    pairs = docs.select(*keep, _words(_spaced()).alias("w")).select(*keep, F.inline(F.arrays_zip(F.col("w").alias("one"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("two"))))
    return pairs.select(*keep, F.pmod(F.xxhash64("one"), F.lit(SLOTS)).alias("slot"), F.pmod(F.xxhash64("one", "two"), F.lit(SLOTS)).alias("pair"))


def _repeated() -> Column:
    """How many words stand in 3-word windows that occur at least twice, from the windows' hashes.

    A text with as many distinct windows as windows has none. Otherwise windows and their places are sorted together,
    so that equal ones stand side by side; the places of those that do cover up to three words each.
    """
    zero, three = F.lit(0).cast("long"), F.lit(3).cast("long")
    windows = F.transform(F.slice("words", 1, F.size("words") - 2), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))

    def covered(w):
        told = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

        def twice(s):
            same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))

        places = _let(told, twice)
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(three, F.coalesce(F.get(p, k + 1) - x, three))), zero, lambda a, x: a + x))

    return F.when(F.size("words") >= 4, _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), zero).otherwise(covered(w)))).otherwise(zero)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with the base columns."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    told = docs.withColumn("spaced", _spaced())
    told = told.withColumn("words", _words(F.col("spaced"))).withColumn("n_words", F.size("words").cast("long"))
    blanks = F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit("")))
    told = told.withColumn("word_chars", (F.length("spaced") - blanks).cast("long"))
    plain = F.col("spaced")
    for c in "#*$%&|<>":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    told = told.withColumn("n_symbols", (F.octet_length("spaced") - F.octet_length(plain)).cast("long"))
    told = told.withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    told = told.withColumn("n_repeat_words", _repeated())
    return told.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("spaced")


def slot_counts(docs: DataFrame) -> DataFrame:
    """(slot, n) over all n-grams of docs."""
    return _n_grams(docs).select(F.explode(F.array("slot", "pair")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most TRUSTED ids of trusted rows."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base columns, score and kept for each row of docs."""
    spark = docs.sparkSession
    ws = C.Workspace(spark)
    docs = docs.select("doc_id", "text")
    trusted = docs.join(F.broadcast(trusted_ids(labels)), "doc_id", "left_semi")  # at most TRUSTED bigints
    every = spark.range(SLOTS).select(F.col("id").alias("slot"))
    both = every.join(slot_counts(docs).withColumnRenamed("n", "raw"), "slot", "left").join(slot_counts(trusted).withColumnRenamed("n", "target"), "slot", "left").na.fill(0)
    whole = Window.partitionBy()  # SLOTS rows
    raw = (F.col("raw") + ADD) / (F.sum("raw").over(whole) + ADD * SLOTS)
    target = (F.col("target") + PRIOR * raw) / (F.sum("target").over(whole) + PRIOR)
    table = ws.store(both.select("slot", F.log(target / raw).alias("ratio")), "ratios")  # SLOTS rows
    # rows with equal keys are equal texts, whose mean is the same over one copy or all
    key = (F.col("doc_id"), F.xxhash64("text").alias("mark"))
    one, two = F.broadcast(table.select("slot", "ratio")), F.broadcast(table.select(F.col("slot").alias("pair"), F.col("ratio").alias("pair_ratio")))
    scored = _n_grams(docs.select("doc_id", key[1], "text"), "doc_id", "mark").join(one, "slot").join(two, "pair")
    scored = scored.groupBy("doc_id", "mark").agg((F.avg(F.col("ratio") + F.col("pair_ratio")) / 2).alias("score"))
    told = base_counts(docs.select("doc_id", key[1], "text")).drop("text", "words")
    scored = scored.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.round("score", 9).alias("score"))
    told = told.join(scored, told.doc_id.eqNullSafe(scored.d) & (told.mark == scored.m), "left")
    kept = ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= FLOOR)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")
