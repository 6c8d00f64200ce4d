"""From raw documents to packed training sequences, in five stages that each apply one corpus operator.

1. language: documents without letters, or that belong to none of the languages learned, go.
2. exact_dedup: of equal texts one row stays.
3. near_dedup: of each class of near duplicates one document stays.
4. pii: personal data are replaced by their kinds; no document goes.
5. packing: every document's tokens are placed in sequences; the result has a row for each piece.

Every stage but the last returns the columns of documents, whatever their names: extra columns pass through as they
are, and no column of a stage's own is left behind.  A stage's result is written as Parquet in the shared folder and
read again by the next stage.

Cases: a null or empty text, or one without letters, goes in the first stage; a null lang or source changes nothing; a
null doc_id is kept like any other; of repeated rows one stays; texts of any length are read whole; where no row has a
language to learn from, all texts with letters stay; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import best_fit_packing, dart_minhash, exact_dedup, pii_crf, string_kernel_lang
from factloom.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return string_kernel_lang.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", pii), ("packing", packing)]

#: SQL can express neither the kernel, the field nor the packing; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
