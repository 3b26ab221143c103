"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.  Other columns of a
table are left out from the first stage on, whatever their names.  All stages take null keys, null and empty texts, ties,
repeated rows and empty tables; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.llm import ngram_join, packing, personal_data, quality_knn, suffix_dedup
from docfathom.llm.store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    Null and empty texts have the score of the labelled rows' share of label 1 and stay with them; repeated rows are judged
    alike; a null key is judged by its text.
    """
    return quality_knn.accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest key, null keys last.

    Rows are told apart by key and text: another text under the same key is another document; repeated rows are one.
    Texts without words are in no group and stay.
    """
    return ngram_join.without_near_duplicates(docs.select(*COLUMNS), size=5, threshold=(80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that also start earlier: one row for each, an empty text where nothing is left.

    Null keys come before all others; a null text becomes an empty one.
    """
    cut = suffix_dedup.dedup_substrings(docs.select(*COLUMNS), carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind: one row for each; a null text stays null, with null characters."""
    return personal_data.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences; a null or empty text is its end mark alone."""
    return packing.pack(docs.select(*COLUMNS), with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal),
    ("best-fit packing", sequences),
]

#: No stage can be expressed in SQL: tests/llm/test_pipeline.py holds each against brute force or its operator, itself tested so.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
