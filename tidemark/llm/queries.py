"""Queries of the language-model problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.neighbours import nearest_neighbours, similar_pairs
from tidemark.llm.ranking import borda_ranking
from tidemark.llm.source_files import unwritten_files
from tidemark.llm.stuffing import stuffed_pages
from tidemark.llm.tokens import count_tokens, encode_corpus
from tidemark.session import read_table

SCORES = {"score": -1.0, "rrf_score": 1.0, "confidence": 1.0}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return borda_ranking(read_table(spark, sf, "search_hits"), "query_id", "hit_id", SCORES, top=3).select("query_id", "place", "hit_id")


def p1_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return borda_ranking(read_table(spark, sf, "search_hits"), "query_id", "hit_id", SCORES).withColumn("points", F.round("points", 6))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_reasons(spark, sf).select("file_path")


def p3_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return unwritten_files(read_table(spark, sf, "code_chunks"), read_table(spark, sf, "upstream_files")).withColumnRenamed("path", "file_path")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_shares(spark, sf).select("doc_id")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(read_table(spark, sf, "documents"), "doc_id", "text")


def _neighbours(spark: SparkSession, sf: str, least: float | None = None) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf, "code_chunks"), "id", "vector", k=5, least=least)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(_neighbours(spark, sf, 0.9), 0.9)


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).withColumn("cosine", F.round("cosine", 6))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf: str):
    docs = count_tokens(read_table(spark, sf, "documents").select("doc_id", "source", "lang", "project", "text"), "text")
    docs, targets = mixing.normalised(docs, read_table(spark, sf, "mix_targets"), "doc_id", "source", "lang", "project", "tokens")
    return mixing.mix_sources(docs, targets, "doc_id"), docs, targets


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(*_mixture(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p3_found, p3_reasons, p7_found, p7_neighbours, p8_ids, p9_mixture, p9_shares, p10_found, p10_shares)}

_BORDA = """WITH items AS (SELECT query_id, hit_id, max(-score::double) s0, max(rrf_score::double) s1, max(confidence::double) s2
  FROM search_hits WHERE query_id IS NOT NULL AND hit_id IS NOT NULL GROUP BY ALL),
long AS (SELECT query_id, hit_id, unnest([{'k': 0, 'v': s0}, {'k': 1, 'v': s1}, {'k': 2, 'v': s2}], recursive := true) FROM items),
scaled AS (SELECT query_id, hit_id, CASE WHEN v IS NULL THEN 0.5 ELSE
  (count(v) OVER (PARTITION BY query_id, k) - (rank() OVER (PARTITION BY query_id, k ORDER BY v DESC NULLS LAST) - 1) - count(*) OVER (PARTITION BY query_id, k, v) / 2.0)
  / count(v) OVER (PARTITION BY query_id, k) END p FROM long),
sums AS (SELECT query_id, hit_id, round(sum(p::double * (1.0::double / 3)), 12) points FROM scaled GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, hit_id)::int place FROM sums)
"""
_NEAR = """WITH u AS (SELECT DISTINCT id, vector::DOUBLE[] v FROM code_chunks WHERE list_sum(list_transform(vector, lambda x: abs(x))) > 0),
w AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM u),
c AS (SELECT a.id, b.id neighbour, list_dot_product(a.v, b.v) cosine FROM w a JOIN w b ON a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 6) DESC, neighbour)::int place FROM c QUALIFY place <= 5)
"""

SQL = {
    "p1_found": _BORDA + "SELECT query_id, place, hit_id FROM placed WHERE place <= 3",
    "p1_ranking": _BORDA + "SELECT query_id, hit_id, round(points, 6) points, place FROM placed",
    "p7_found": _NEAR + "SELECT DISTINCT least(id, neighbour) id_a, greatest(id, neighbour) id_b FROM n WHERE cosine >= 0.9",
}
