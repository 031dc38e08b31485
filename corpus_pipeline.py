"""A cleaning pipeline over ``documents``: rules, classifier, near-duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table, written
from evidra.llm.jaccard_join import near_documents
from evidra.llm.mixing import mixed_documents
from evidra.llm.quality_classifier import keep_classified
from evidra.llm.quality_rules import keep_good
from evidra.llm.queries import vocabulary
from evidra.llm.sentence_pieces import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the risk-controlled rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    return keep_classified(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows of one id stay or go together, rows without an id stay."""
    first = near_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their targets: documents repeat, and end at their source's budget."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row of the mixture, with the check that they decode to its text."""
    return encode_documents(docs, vocabulary("piece_bpe_32k.model"), ids=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: Fitted models, components and the mixture's keys can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
