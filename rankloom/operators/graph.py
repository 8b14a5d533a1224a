"""PageRank with dangling mass, over an edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import delete, written


def out_degrees(edges: DataFrame) -> DataFrame:
    """src_id, out_degree: distinct targets."""
    return edges.select("src_id", "dst_id").distinct().groupBy("src_id").agg(F.count(F.lit(1)).alias("out_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src_id, neighbours: a view for export."""
    return edges.groupBy("src_id").agg(F.array_sort(F.collect_set("dst_id")).alias("neighbours"))


def dangling_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id of nodes without an outgoing edge."""
    return nodes.select("doc_id").distinct().join(edges.select(F.col("src_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, report: Callable[[int, float, float], None] | None = None) -> DataFrame:
    """doc_id, pagerank after a fixed number of rounds.

    Every node starts with 1/N. A round gives each node (1 - d)/N + d * (what its neighbours pass on +
    dangling mass / N). Repeated edges count once, self-loops stay, an edge to no node loses its mass,
    one from no node passes nothing. Zero or fewer rounds leave 1/N.

    Edges with their out-degree and nodes with a dangling flag are written once; the ranks after each
    round are written to the shared folder, which cuts the lineage and outlives a lost executor. A
    round is one job with partial sums before its exchanges; the dangling mass is a scalar in it.
    ``report``, where given, is told after each round its number, the dangling mass and the sum of ranks.
    """
    spark = nodes.sparkSession
    distinct = edges.select("src_id", "dst_id").distinct()
    links, links_path = written(distinct.join(out_degrees(edges), "src_id"), "links")
    ids = nodes.select("doc_id").distinct()
    flagged = ids.join(links.select(F.col("src_id").alias("doc_id")).distinct().withColumn("_out", F.lit(True)), "doc_id", "left").select("doc_id", F.col("_out").isNull().alias("dangling"))
    base, base_path = written(flagged, "nodes")
    n = base.count()
    ranks, old = base.select("doc_id", "dangling", F.lit(1.0 / n if n else 0.0).alias("pagerank")), None
    for round_ in range(1, max(0, iterations) + 1):
        passed = links.join(ranks.select(F.col("doc_id").alias("src_id"), "pagerank"), "src_id").groupBy(F.col("dst_id").alias("doc_id")).agg(F.sum(F.col("pagerank") / F.col("out_degree")).alias("_in"))
        mass = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0)).alias("_mass"))
        new = F.lit((1 - damping) / n if n else 0.0) + F.lit(damping) * (F.coalesce("_in", F.lit(0.0)) + F.col("_mass") / F.lit(float(n or 1)))
        ranks, path = written(base.join(passed, "doc_id", "left").join(F.broadcast(mass)).select("doc_id", "dangling", new.alias("pagerank")), "ranks")
        if report:
            report(round_, mass.first()[0], ranks.agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0])
        if old:
            delete(spark, old)
        old = path
    out = ranks.select("doc_id", "pagerank")
    if iterations > 0:
        delete(spark, links_path)
        delete(spark, base_path)
    return out


def rank_mass(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("pagerank").alias("mass"))
