"""The thin queries: each applies one operator to its whole table and shapes the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (html_text, mixing, phrases, quality_model, quality_rules, segmentations, simhash, token_counts, topk, toxicity, trie,
               vector_copies, warc)
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's samples; the ids as their number and a hash."""
    return segmentations.encode(read(spark, sf_dir, "documents")).select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed",
        "inclusion", "exact")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents")).drop("host", "text_hash")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"), payloads=False).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.graded(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.sequences(read(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_segmentations": op2_segmentations,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_exact_topk": op5_exact_topk,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_vector_copies": op11_vector_copies,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
