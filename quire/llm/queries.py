"""The operators' registered queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .byte_pairs import encode_texts
from .epsilon_grid import link_embeddings
from .filter_audit import audit_filters
from .html_text import extract_articles
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .prefix_trie import conversation_trie
from .substring_dedup import remove_repeated_passages
from .quality import classify
from .segmentation import sample_segmentations
from .shared import Tables
from .suffix_dedup import remove_repeated_bytes
from .transport_stream import media_features, text_to_media
from .warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), digest=True)


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), digest=True)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Tables(spark).keep(text_to_media(table(spark, sf_dir, "documents")), "media")
    return media_features(stored).withColumnRenamed("id", "doc_id")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express: what was stored, and the digest of what was read back."""
    return op8_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op9_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), digest=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), digest=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_epsilon_grid, op2_sentencepiece_sampling, op3_entropy_mixing, op4_quality_classifier, op5_substring_dedup, op6_minhash_dedup, op7_html_text, op8_transport_stream, media_payloads, op9_warc_dictionary, op10_suffix_dedup, op11_filter_audit, op12_byte_pairs, op13_prefix_trie)}
