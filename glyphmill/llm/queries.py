"""The queries opN_<name>: each operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, conversation_repair, html_extract, language_id, lm_quality, lm_scoring, mixing, near_dedup, packing, quality_rules, sharding, token_alignment, vector_dedup
from .common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents, at similarity 0.75 on five words."""
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of documents."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of documents; see sharding."""
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, base_failed, score and kept for every row of documents; labels give the trusted target."""
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, surprise, its bounds and kept for every row of documents; labels name the trusted text."""
    return lm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of documents, learnt from the rows that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents with their bin and offset; see packing."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_trigram, n_bigram, log10_score and log10_per_word for every row of documents, rounded for comparison."""
    told = lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"))
    return told.withColumn("log10_score", F.round("log10_score", 4)).withColumn("log10_per_word", F.round("log10_per_word", 6))


def op10_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of embeddings, at cosine 0.98."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and their corpus-wide counts for every row of documents; see token_alignment."""
    return token_alignment.aligned(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every conv_id of conversations, after the damage."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of what they decode to, for every row of documents."""
    return bpe_tree.digests(table(spark, sf_dir, "documents"))


_ALL = (
    op1_minhash_near_dedup,
    op2_kneser_ney_quality,
    op3_string_kernel_language,
    op4_template_extraction,
    op5_best_fit_packing,
    op6_mix_sources,
    op7_histogram_shards,
    op8_stupid_backoff,
    op9_quality_rules,
    op10_spherical_cap_dedup,
    op11_token_alignment,
    op12_conversation_repair,
    op13_bpe_tree,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op10_spherical_cap_dedup": vector_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op8_stupid_backoff": lm_scoring.ORACLE,
}
