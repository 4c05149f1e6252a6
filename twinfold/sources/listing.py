"""A file listing made from the documents table: roots, hardlinks, a second mount, an overlapping root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def base_rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.when(F.col("doc_id") % 10 == 0, ".bak").when(F.col("doc_id") % 10 == 1, ".tmp").otherwise(".txt")
    return documents.select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"),
        F.octet_length(text).cast("long").alias("size"),
        (F.lit(1_600_000_000_000_000_000) + F.col("doc_id")).alias("mtime_ns"),
        (F.substring("source", 4, 20).try_cast("long") % 2).alias("dev"),
        F.col("doc_id").cast("long").alias("ino"),
        text.cast("binary").alias("content"),
        "source",
    )


def roots(documents: DataFrame) -> list[DataFrame]:
    """The roots of the listing, each a bag of rows."""
    base = base_rows(documents)
    return [
        base,
        base.where("ino % 7 = 0").withColumn("path", F.concat(F.lit("/links"), "path")),
        base.where("ino % 5 = 0").withColumn("path", F.concat(F.lit("/mirror"), "path")).withColumn("dev", F.col("dev") + 10),
        base.where("source = 'src1'"),
    ]


def union_roots(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of listings with root_idx; rows of overlapping roots stay twice."""
    return reduce(DataFrame.unionByName, (p.withColumn("root_idx", F.lit(k)) for k, p in enumerate(parts)))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = union_roots(roots(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("content", "source")
    return rows.withColumn("nlink", F.count("*").over(Window.partitionBy("dev", "ino")))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, content) of each path once."""
    return union_roots(roots(spark.read.parquet(f"{sf_dir}/documents.parquet"))[:3]).select("path", "size", "content")
