"""The versioned personal store: cleaning on the way in, merging imports by each collection's rule, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Collections of a store of version 3.
COLLECTIONS = ("crops", "orders", "bookmarks", "searches", "pagesets", "places")


def first_of(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row for each of keys, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def clean_order(sheets: DataFrame, known: DataFrame) -> DataFrame:
    """order sheets that exist, each once where it first stands; every other known sheet comes last, set aside."""
    kept = first_of(sheets.join(known.select("sheet"), "sheet", "left_semi"), ["order_id", "sheet"]).select("order_id", "sheet", "quire", "ord")
    # an order's sheets as one array against the book's: a row for each order, not for each order and sheet
    book = known.agg(F.collect_set("sheet").alias("all"))
    left = kept.groupBy("order_id").agg(F.collect_set("sheet").alias("own")).join(F.broadcast(book)).select("order_id", F.explode(F.array_except("all", "own")).alias("sheet"))
    return kept.unionByName(left.select("order_id", "sheet", F.lit(None).cast("string").alias("quire"), F.lit(None).cast("int").alias("ord")))


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(1), F.lit(most))


def clean_bookmarks(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks of pages in the book, one a page, with a note of at most 500 characters."""
    return first_of(rows.join(pages.select("page"), "page", "left_semi"), ["page"]).withColumn("note", F.substring(F.coalesce("note", F.lit("")), 1, 500))


def _named(name: Column, most: int) -> Column:
    return F.left(F.btrim(F.coalesce(name, F.lit(""))), F.lit(most))


def clean_searches(rows: DataFrame) -> DataFrame:
    """Kept searches(id, name, hash): only addresses of searches, cut to 2,000 characters; a name of at most 80, or Search."""
    told = rows.filter(F.col("hash").rlike(r"^#text/[^/]*/search"))
    return told.select("id", F.coalesce(F.nullif(_named(F.col("name"), 80), F.lit("")), F.lit("Search")).alias("name"), F.left("hash", F.lit(2000)).alias("hash"))


def clean_sets(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Page sets(id, name, page, ord), a row a page: known pages once, where they first stand; the name as a slug of 40; no empty sets or names."""
    name = F.left(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.coalesce("name", F.lit("")))), "[^a-z0-9-]+", "-"), "^-|-$", ""), F.lit(40))
    known = rows.join(pages.select("page"), "page", "left_semi").withColumn("name", name).filter("name <> ''")
    return first_of(known, ["id", "name", "page"]).groupBy("id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page"))), lambda x: x["page"]).alias("pages"))


def clean_places(rows: DataFrame) -> DataFrame:
    """Notes on places(id, hash, label, note): only addresses of words in a text; label to 120 characters, note to 2,000."""
    told = rows.filter(F.col("hash").rlike(r"^#read/[^/]*/[^/]+/text\?w="))
    return told.select("id", F.left("hash", F.lit(2000)).alias("hash"), _named(F.col("label"), 120).alias("label"), _named(F.col("note"), 2000).alias("note"))


def in_reading_order(bookmarks: DataFrame, order: DataFrame) -> DataFrame:
    """bookmarks(page, ord) with row, their number in the reading order(page, pos); pages it leaves out come last, as they stand."""
    first = order.groupBy("page").agg(F.min("pos").alias("pos"))
    w = Window.orderBy(F.col("pos").asc_nulls_last(), "ord")  # a person's bookmarks
    return bookmarks.join(first, "page", "left").withColumn("row", F.row_number().over(w)).drop("pos")


def skip_known(mine: DataFrame, theirs: DataFrame, *keys: list[str]) -> DataFrame:
    """mine and what theirs adds: a row whose value is mine already by any of keys is left out, and so is a repeat."""
    for key in keys:
        theirs = first_of(theirs.join(mine.select(*key).distinct(), key, "left_anti"), key)
    return mine.unionByName(theirs.select(mine.columns))


def replace_by_id(mine: DataFrame, theirs: DataFrame, versions: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Orders: theirs replace mine by id; what was replaced becomes the newest of at most most versions, unless it equals the newest."""
    out = mine.join(theirs.select("id"), "id", "left_anti").unionByName(theirs.select(mine.columns))
    was = mine.join(theirs.select("id"), "id", "left_semi").select("id", "body", F.lit(0).alias("age"))
    newest = versions.filter("age = 1").select("id", F.col("body").alias("last"))
    was = was.join(newest, "id", "left").filter("last is null or last <> body").select("id", "body", "age")
    all_ = versions.select("id", "body", "age").unionByName(was)
    kept = all_.withColumn("age", F.row_number().over(Window.partitionBy("id").orderBy("age"))).filter(F.col("age") <= most)
    return out, kept


def upsert(sets: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    return sets.join(new.select(key), key, "left_anti").unionByName(new.select(sets.columns))


def restored(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two stores of one thing: first's value where it has any, else second's."""
    return first.withColumnRenamed("value", "x").join(second.withColumnRenamed("value", "y"), key, "full").select(key, F.coalesce(F.nullif("x", F.lit("")), "y").alias("value"))


def migrate_crops(crops: DataFrame, retired: DataFrame) -> DataFrame:
    """Crops of retired panels moved to what took their place: only corners that stood on the shared edge go along, once.

    crops(panel, corners array of (x, y), done), retired(panel, into, edge, dx): edge names x of the shared edge.
    """
    told = crops.join(retired, "panel")
    moved = F.transform("corners", lambda c: F.when(F.abs(c["x"] - F.col("edge")) < 1e-9, F.struct((c["x"] + F.col("dx")).alias("x"), c["y"].alias("y"))).otherwise(c))
    new = told.filter("not done").select(F.col("into").alias("panel"), moved.alias("corners"), F.lit(False).alias("done"))
    new = new.join(crops.select("panel"), "panel", "left_anti")
    marked = crops.join(retired.select("panel").withColumn("gone", F.lit(True)), "panel", "left").select("panel", "corners", (F.col("done") | F.coalesce("gone", F.lit(False))).alias("done"))
    return marked.unionByName(new)
