"""Roles of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: case_id, text, domain (language), label (quality), family (source), split."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("case_id"), "text", F.col("lang").alias("domain"), F.col("quality").cast("string").alias("label"), F.col("source").alias("family"), split.alias("split"), "toxic")


CASES = """cases AS (
  SELECT d.doc_id AS case_id, d.text, d.lang AS domain, CAST(l.quality AS VARCHAR) AS label, d.source AS family,
         CASE WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: unit (order), rater (line number), label (return flag), grade (quantity in tens)."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), F.col("l_returnflag").alias("label"), F.floor(F.col("l_quantity") / 10).alias("grade"), "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


RATINGS = """ratings AS (
  SELECT l_orderkey AS unit, l_linenumber AS rater, l_returnflag AS label, CAST(floor(l_quantity / 10) AS BIGINT) AS grade,
         l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
