"""Bag-of-words retrieval over postings with a category boost and a top K for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_alnum

BOOST = 0.2


def match_scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, target_category, category, tfidf_score: a repeated query term adds its score again.

    A document that stands twice is one hit: its postings add up, and of its categories the largest counts.
    """
    terms = queries.select("query_id", "target_category", F.explode(tokens_alnum(F.col("query_text"))).alias("term"))
    # The semi-join goes below the sums of a lazy index: only asked terms are then counted.
    hits = postings.join(terms.select("term").distinct(), "term", "left_semi").join(terms, "term")
    return hits.groupBy("query_id", "doc_id", "target_category").agg(F.max("category").alias("category"), F.sum("tfidf").alias("tfidf_score"))


def search(postings: DataFrame, queries: DataFrame, k: int = 10, boost: float = BOOST) -> DataFrame:
    """query_id, doc_id, tfidf_score, category_score, retrieval_score, rank; scores at four decimals.

    A document's category matches if it contains the target, so an empty target matches all. Equal
    scores (at six decimals) go by doc_id.
    """
    scored = match_scores(postings, queries).withColumn("category_score", F.col("category").contains(F.col("target_category")).cast("int"))
    scored = scored.withColumn("_s", F.round(F.col("tfidf_score") + F.lit(boost) * F.col("category_score"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("_s").desc(), F.col("doc_id"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # planned with a limit for each group below the exchange
    return top.select("query_id", "doc_id", F.round("tfidf_score", 4).alias("tfidf_score"), "category_score", F.round("_s", 4).alias("retrieval_score"), "rank")
