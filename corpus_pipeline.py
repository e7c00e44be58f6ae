"""From raw to training documents: quality rules, line dedup, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
documents. All but the last return the columns of documents.

Results that are defined: the first stage rejects null and empty texts, having no words. Null ids are ids like others; rows with equal ids stay rows of their
own, but equal rows are near-duplicates, of which one stays (the least id, a null one last). Columns besides those of documents, whatever
their names, are left out by the first stage. No documents give no rows, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, quality, shingles
from lodestone.llm.common import materialize, table
from lodestone.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs; a document of which nothing is left goes."""
    cleaned = line_dedup.dedup_lines(docs)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.size("removed_lines") == 0)
    return cleaned.where(left).withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more, or close fingerprints."""
    return shingles.keep_one(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of them and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: Hashes of lines and shingles decide which copies stay: no SQL for it here; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
