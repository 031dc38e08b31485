"""Queries of the operators in this folder, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.ann_search import nearest
from evidra.llm.common import table
from evidra.llm.embed_dedup import near_vectors
from evidra.llm.importance import resample
from evidra.llm.jaccard_join import near_documents
from evidra.llm.lm_score import score_texts
from evidra.llm.mixing import mix_sources
from evidra.llm.quality_classifier import classify
from evidra.llm.quality_rules import judge_quality
from evidra.llm.sentence_pieces import encode_documents
from evidra.llm.token_counts import count_tokens
from evidra.llm.token_files import token_files
from evidra.llm.url_filter import ALLOW, BLOCK, filter_urls
from evidra.llm.whitening import whiten

#: Fixed rules of the url query.
URL_RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2, f"tokens-{uuid.uuid4().hex}")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whiten(table(spark, sf_dir, "embeddings"))
    return got.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_lm_score": op6_lm_score,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filter": op10_url_filter,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, t, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, p.host, p.path, r.h || r.t AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.h || r.t) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
