"""The corpus pipeline: stages that each apply one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.minhash_dedup import near_duplicates
from quire.llm.mixing import mix_documents
from quire.llm.quality import good_documents
from quire.llm.queries import table
from quire.llm.segmentation import sample_segmentations
from quire.llm.shared import Tables, broadcast_if_small
from quire.llm.substring_dedup import rewritten_documents


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of those that repeat an id and its text."""
    tables = Tables(spark)
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(broadcast_if_small(tables.keep(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
    again = tables.keep(left.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if again.isEmpty():
        return left
    known = F.broadcast(again) if again.limit(1_000_000).count() < 1_000_000 else again
    single = left.join(known, left["doc_id"].eqNullSafe(known["id"]), "left_anti")
    many = left.join(known, left["doc_id"].eqNullSafe(known["id"]), "left_semi")
    return single.unionByName(many.dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go; n_chars follows the text."""
    return rewritten_documents(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; rows that repeat id, text and source stand as copies of one of them."""
    mixed = Tables(spark).keep(mix_documents(docs).groupBy("id", "key", "source").agg(F.sum("copies").alias("copies"), F.sum("n").alias("n")).where("copies > 0"), "copies")
    copies = mixed.select(F.struct("id", "key", "source", "copies", "n").alias("taken_copies"))
    own = docs.select(F.struct(*docs.columns).alias("mixed_document"), F.xxhash64("doc_id", "text").alias("mixed_key"))
    same = (F.col("mixed_key") == F.col("taken_copies.key")) & F.col("mixed_document.doc_id").eqNullSafe(F.col("taken_copies.id")) & F.col("mixed_document.source").eqNullSafe(F.col("taken_copies.source"))
    taken = own.join(broadcast_if_small(copies, row_bytes=100), same)
    if not mixed.where("n > 1").isEmpty():
        many = taken.where("taken_copies.n > 1")
        many = many.groupBy("taken_copies").agg(F.first("mixed_document").alias("mixed_document"), F.first("mixed_key").alias("mixed_key")).select("mixed_document", "mixed_key", "taken_copies")
        taken = taken.where("taken_copies.n = 1").unionByName(many)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken_copies.copies")))
    return taken.select("mixed_document", times).select("mixed_document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document."""
    return sample_segmentations(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("entropy mixing", mix),
    ("sentencepiece sampling", encode),
]

#: SQL can't express the expectation-maximisation, the scorers and the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    tables, docs = Tables(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
