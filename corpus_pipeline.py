"""The corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of documents. run() writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import mixing, packing, pii, quality_classifier, simhash_similar
from twinfold.llm.common import Scratch, chosen, durable, spread_join, table
from twinfold.llm.simhash_similar import ROW

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each by its own text. Only rows of labels teach it."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that with the smallest id (nulls last); of equal ids any one."""
    rows = simhash_similar.numbered(docs)
    with Scratch(spark) as scratch:
        classes = scratch.table(rows.select("doc_id", ROW).join(simhash_similar.similar_rows(rows), ROW), "classes")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
        first = classes.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).select("component", F.col(f"first.{ROW}").alias("stays"), "n")
        gone = durable(spread_join(classes, scratch.table(first, "first-rows"), ["component"], classes.count()).where(F.col(ROW) != F.col("stays")).select(ROW), "near-duplicates")
    return chosen(rows, gone, ROW, gone.count(), but=True).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars counts the new text."""
    return pii.sanitise(docs).withColumn("text", F.col("clean_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count, in global random order."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]

#: The classifier, the tokenizer and the packing aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
