"""From raw documents to packed bins: quality, language, near-duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir), reads docs and, for the first, the labels beside them, and returns a frame that
is written and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import language_id, lm_quality, mixing, near_dedup, packing
from glyphmill.llm.common import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose perplexity stays between their language's bounds; labels beside the documents name trusted text.

    Null, empty and white-space texts go; a null language has the bounds of all languages together; a text at a bound
    stays. Rows that repeat a doc_id stay or go together, all going if one goes; rows without a doc_id are judged each.
    Extra columns and clashing names come through; an empty table gives an empty result.
    """
    return lm_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told from their text.

    Texts that are null or have no letter go, as do texts that are as far from all learned languages. Ties between
    languages stay. Without a language to learn from, every text goes. Repeats, missing ids, extra columns and empty
    tables as in quality.
    """
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id.

    Null and empty texts are no one's duplicates and stay. Rows that repeat a doc_id are one document. A row without a
    doc_id takes part under a number above all ids, so that it goes if it copies a row that has one. Extra columns and
    empty tables as in quality.
    """
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks, up to three times.

    Documents without words are not taken; a null source is a source; documents of one rank are ordered by a hash of
    doc_id. Rows that repeat a doc_id within a source are planned as one and taken together. Extra columns and empty
    tables as in quality.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bin and offset, at most two of a source and one of a duplicate cluster a bin.

    Null and empty texts have one piece without a bin. Repeats, which mix makes, are pieces of their own and stand in
    bins of their own. Extra columns are ignored; an empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
