"""A training corpus from documents: quality rules, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever these are and whatever their names. Empty tables give
empty results; no stage but the first two drops rows other than by the mix's rates, and a row with a null doc_id is a row like any other.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.functions.lineage import remove, remove_at_exit, shared_dir
from foliospark.llm import mixing, neardup, packing, quality, secretscan
from foliospark.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition coverage reject go; the others stay as they are.

    Null, empty and blank texts have no words, so they are rejected. Repeated rows and null ids make no difference.
    """
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Of rows that repeat a doc_id one stays; rows with a null doc_id and texts without words all stay.
    """
    return neardup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows. No document goes; null and empty texts stay as they are."""
    return secretscan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    Texts without words are taken once. A null source is a source of its own; equal rows are taken equally often.
    """
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of up to 2048 tokens, each row's once; a null or empty text is the separator alone."""
    return packing.packed_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secrets", secrets), ("mix_sources", mix_sources), ("pack", pack)]

#: Shingle links and packing aren't expressed in SQL: the tests compare each stage with its operator, which its own tests hold against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents.

    Stages are written to the folder that driver and executors share; each goes once the next one is written, the last when the
    application ends.
    """
    root, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            remove(spark, f"{root}/{before}")
        before = name
    remove_at_exit(spark, root)
    return docs
