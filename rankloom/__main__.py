"""Command line: ``python -m rankloom clean|classify|search|rank ...``, reading and writing the tab-separated files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import classify, cleaning, fusion, graph, index
from .operators import search as searching
from .sources import sinks, tsv
from .storage import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom")
    p.add_argument("--local", action="store_true", help="run on all cores of this machine")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("clean")
    for a in ("pages", "links", "stopwords", "out"):
        c.add_argument(a)
    c = sub.add_parser("classify")
    for a in ("pages", "train_ids", "test_ids", "pred_out", "report_out"):
        c.add_argument(a)
    c.add_argument("algorithm", nargs="?", default="mnb", type=str.lower, choices=classify.ALGORITHMS)
    c = sub.add_parser("search")
    for a in ("pages", "pred_category", "queries", "index_out", "topk_out"):
        c.add_argument(a)
    c.add_argument("k", type=int, nargs="?", default=10)
    c = sub.add_parser("rank")
    for a in ("pages", "links", "topk", "out"):
        c.add_argument(a)
    c.add_argument("iterations", type=int, nargs="?", default=10)
    c.add_argument("damping", type=float, nargs="?", default=0.85)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.job == "clean":
        words = tsv.read_words(spark, a.stopwords)
        print(f"[clean] stopwords loaded = {len(cleaning.word_list(words))}")
        pages, links, stats = cleaning.clean_corpus(tsv.read_pages(spark, a.pages), tsv.read_links(spark, a.links), words)
        sinks.save_single_tsv(pages, f"{a.out}/clean_pages.tsv")
        sinks.save_single_tsv(links, f"{a.out}/clean_links.tsv")
        figures = written(stats, "stats")[0]  # counted once, for the file and the console
        sinks.save_text(sinks.stats_json(figures), f"{a.out}/clean_stats.json")
        s = figures.first()
        print(f"[clean] pages: {s.pages_before} -> {s.pages_after}")
        print(f"[clean] links: {s.links_before} -> {s.links_after} (illegal={s.removed_illegal_edges}, duplicate={s.removed_duplicate_edges})")
    elif a.job == "classify":
        pages = tsv.read_clean_pages(spark, a.pages)
        model = classify.train_nb(classify.train_pages(pages, tsv.read_ids(spark, a.train_ids)))
        found = classify.predict_nb(model, classify.test_pages(pages, tsv.read_ids(spark, a.test_ids)), a.algorithm)
        sinks.save_single_tsv(found, a.pred_out, "doc_id")
        sinks.save_text(classify.report_text(model, found, classify.TITLES[a.algorithm]), a.report_out)
    elif a.job == "search":
        pages = index.final_label(tsv.read_clean_pages(spark, a.pages), tsv.read_pred_category(spark, a.pred_category))
        postings = index.build_index(pages).persist()
        sinks.save_single_tsv(index.posting_lists(postings), a.index_out, "term")
        top = searching.search(postings, tsv.read_queries(spark, a.queries), a.k)
        rows = top.select("query_id", "doc_id", sinks.number("tfidf_score", 4).alias("tfidf_score"), "category_score", sinks.number("retrieval_score", 4).alias("retrieval_score"), "rank")
        sinks.save_single_tsv(rows, a.topk_out, "query_id", "rank")
        postings.unpersist()
    else:
        nodes, edges = tsv.read_nodes(spark, a.pages), tsv.read_edges(spark, a.links)
        print(f"[rank] N(nodes from clean_pages) = {nodes.distinct().count()}")
        print(f"[rank] dangling nodes = {graph.dangling_nodes(nodes, edges).count()}")
        told = lambda k, mass, total: print(f"[rank] iter={k:2d}  danglingMass={mass:.6f}  PRsum={total:.6f}")
        ranks = graph.pagerank(nodes, edges, a.iterations, a.damping, report=told)
        sinks.save_single_tsv(ranks.select("doc_id", sinks.number("pagerank", 8).alias("pagerank")), f"{a.out}/pagerank.tsv", "doc_id")
        final = fusion.fuse_rank(tsv.read_retrieval_topk(spark, a.topk), ranks)
        rows = final.select("query_id", "doc_id", sinks.number("retrieval_score", 6).alias("retrieval_score"), sinks.number("pagerank", 8).alias("pagerank"), sinks.number("final_score", 6).alias("final_score"), "rank")
        sinks.save_single_tsv(rows, f"{a.out}/final_rank.tsv", "query_id", "rank")
        print("[rank] done.")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"rankloom-{a.job}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master("local[*]") if a.local else builder).getOrCreate()
    try:
        run(spark, a)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
