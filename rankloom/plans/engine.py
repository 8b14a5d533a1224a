"""The whole way from raw pages and links to a fused ranking, as one call; files only at the ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import classify, cleaning, fusion, graph, index, search


@dataclass
class Run:
    pages: DataFrame
    links: DataFrame
    stats: DataFrame
    predictions: DataFrame
    postings: DataFrame
    topk: DataFrame
    ranks: DataFrame
    final: DataFrame


def classify_and_search(pages: DataFrame, train_ids: DataFrame, test_ids: DataFrame, queries: DataFrame, *, algorithm: str = "mnb", k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, postings, topk) from clean pages."""
    model = classify.train_nb(classify.train_pages(pages, train_ids))
    predictions = classify.predict_nb(model, classify.test_pages(pages, test_ids), algorithm)
    postings = index.build_index(index.final_label(pages, predictions))
    return predictions, postings, search.search(postings, queries, k)


def run_pipeline(raw_pages: DataFrame, raw_links: DataFrame, stopwords: DataFrame | None, train_ids: DataFrame, test_ids: DataFrame, queries: DataFrame, *, algorithm: str = "mnb", k: int = 10, iterations: int = 10, damping: float = 0.85) -> Run:
    pages, links, stats = cleaning.clean_corpus(raw_pages, raw_links, stopwords)
    predictions, postings, topk = classify_and_search(pages, train_ids, test_ids, queries, algorithm=algorithm, k=k)
    ranks = graph.pagerank(pages, links, iterations, damping)
    return Run(pages, links, stats, predictions, postings, topk, ranks, fusion.fuse_rank(topk, ranks))
