"""Pipeline over documents: quality, near-duplicates, contamination, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import decontaminate, packing, pii, quality, simhash
from sparquill.llm.common import delete, shared_folder, table
from sparquill.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 8) does not reject; null and empty texts are judged by their statistics, repeated rows
    each. Without labels all stay; an empty table stays empty. All columns are kept, whatever their names; texts are read whole."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 4): five-word shingles, similarity of 0.8 or more, candidates by SimHash. The
    smallest id stays, null ids last; of rows equal in id and text any one; null, empty and blank texts are one group. An empty table stays
    empty. All columns are kept, whatever their names; texts are compared whole."""
    return simhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (operator 2). Null and empty texts stay; rows equal in id and text share their fate; without
    benchmark items all stay, and an empty table stays empty. All columns are kept, whatever their names; texts are searched whole."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind (operator 10). Null texts stay null, repeated rows are kept, an empty table
    stays empty. All columns are kept, whatever their names; texts are masked whole."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences (operator 7); one row a piece. Null and empty texts are their end mark alone,
    repeated rows are packed each, pieces of equal length take places by their rank; an empty table gives no rows. Long texts are cut into
    pieces, nothing is left out."""
    return packing.best_fit(docs, tokenizer_path(), ["doc_id"])


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_distinct),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: SQL has no factorisation machine, XXH64 or tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted once the next one is there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    return docs
