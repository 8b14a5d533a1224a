"""Link cleaning: valid endpoints, no self-loops, no repeats, and the counts of what went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose both ends are pages and that aren't self-loops. Spark broadcasts the ids where they are small."""
    ids = pages.select("doc_id").distinct()
    out = links.filter("src_id <> dst_id").join(ids.withColumnRenamed("doc_id", "src_id"), "src_id", "left_semi")
    return out.join(ids.withColumnRenamed("doc_id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id")


def clean_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return valid_links(links, pages).distinct()


def link_stats(links: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages and links before and after, links removed as illegal (self-loops too) and as repeats.

    Valid links are counted by pair, so one aggregation gives both how many there are and how many differ.
    """
    pairs = valid_links(links, pages).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))
    after = pairs.agg(F.count(F.lit(1)).alias("links_after"), F.coalesce(F.sum("n"), F.lit(0)).alias("_valid"))
    before = links.agg(F.count(F.lit(1)).alias("links_before"))
    n_pages = pages.agg(F.count(F.lit(1)).alias("pages_before"))
    row = n_pages.join(before).join(after)  # three tables of one row
    return row.select(
        "pages_before",
        F.col("pages_before").alias("pages_after"),
        "links_before",
        "links_after",
        (F.col("links_before") - F.col("_valid")).alias("removed_illegal_edges"),
        (F.col("_valid") - F.col("links_after")).alias("removed_duplicate_edges"),
    )
