"""Fusion of text relevance with link importance, query by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVAL, LINKS = 0.75, 0.25


def minmax(c: str, by: str) -> Column:
    """Scaled to 0..1 within a group; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))


def normalised(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, doc_id, retrieval_score, pagerank) with norm_retrieval and norm_pagerank."""
    return candidates.withColumn("norm_retrieval", minmax("retrieval_score", "query_id")).withColumn("norm_pagerank", minmax("pagerank", "query_id"))


def fuse_rank(topk: DataFrame, ranks: DataFrame, retrieval: float = RETRIEVAL, links: float = LINKS) -> DataFrame:
    """query_id, doc_id, retrieval_score, pagerank, final_score, rank: all candidates that have a rank, none cut off.

    Equal final scores (at six decimals) go by doc_id as text.
    """
    both = topk.select("query_id", "doc_id", "retrieval_score").join(ranks.select("doc_id", "pagerank"), "doc_id")
    scored = normalised(both).withColumn("final_score", F.round(F.lit(retrieval) * F.col("norm_retrieval") + F.lit(links) * F.col("norm_pagerank"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("doc_id").cast("string"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", "doc_id", F.round("retrieval_score", 6).alias("retrieval_score"), F.round("pagerank", 8).alias("pagerank"), "final_score", "rank")
