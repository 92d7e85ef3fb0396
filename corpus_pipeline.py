"""From raw documents to packed training sequences: each stage's rows are written as Parquet and read by the next.

Quality rules and decontamination drop documents, near-duplicate search keeps one document of each group, the secret
scan masks what it finds, and packing turns the rest into windows of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, near_dedup, packing, quality, secrets, shared


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learned from labels do not reject."""
    return quality.filtered(docs, shared.read(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs, size=5, percent=80)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, shared.read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the new text."""
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("near dedup", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: Stages 2 to 5 are not expressible in SQL; tests/llm holds the chain against plain versions of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table. What a stage has stored goes once the next one is done."""
    docs = shared.read(spark, sf_dir, "documents")
    since = shared.made()
    for _, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir))
        shared.release(spark, since, last=1)
    return docs
