"""The engine's tables, made from the generated test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_path

STOPWORDS = ("the", "of", "and", "in", "on", "de", "la", "der", "die", "el")
TARGETS = ("en", "fr", "de", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clean pages: those that ``labels`` covers have their language as label, the others UNKNOWN."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_known", F.lit(True))
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    label = F.when(F.col("_known"), F.col("lang")).otherwise(F.lit("UNKNOWN"))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("clean_text"), label.alias("label"))


def train_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))


def test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return ids.select(F.col("doc_id").cast("string").alias("doc_id"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: their whole text, with a language as target."""
    target = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), target.alias("target_category"))


def marked_up_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every kind of markup that cleaning knows."""
    raw = F.concat(F.lit("{{Infobox|x}} "), F.col("text"), F.lit(" [[Aa|Bee $5 \\ x]] [[Cee]] <ref name=\"q\">gone</ref> <ref name=z /> <b>kept</b> http://e.com/x?y=1 www.e.com/y end"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), raw.alias("raw_text"), F.col("lang").alias("label"))


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dst_id: the user of every event to the user of the event with the next id; loops and repeats stay."""
    e = table(spark, sf_dir, "events")
    following = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").cast("string").alias("dst_id"))
    return e.select("event_id", F.col("user_id").cast("string").alias("src_id")).join(following, "event_id").select("src_id", "dst_id")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dst_id: every user to the types of their events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src_id"), F.col("event_type").alias("dst_id"))


def events_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): users and types of events; users link to who comes next and to types, which all dangle."""
    links = _steps(spark, sf_dir).unionByName(_types(spark, sf_dir))
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("user_id").cast("string").alias("doc_id")).union(e.select("event_type")).distinct()
    return nodes, links


def page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, links): users are the pages, so their links to types of events, and back from them, are illegal."""
    types = _types(spark, sf_dir)
    links = _steps(spark, sf_dir).unionByName(types).union(types.select("dst_id", "src_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id")).distinct(), links


def parts_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): parts linked to their suppliers, which all dangle."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"))
    return li.select(F.col("src_id").alias("doc_id")).union(li.select("dst_id")).distinct(), li


def document_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): documents linked to the one with the next id, to the one with half their id, and to their source, a node that dangles."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    to = F.explode(F.array((F.col("doc_id") + 1).cast("string"), F.expr("doc_id div 2").cast("string"), F.concat(F.lit("source "), "source")))
    nodes = d.select(key.alias("doc_id")).union(d.select(F.concat(F.lit("source "), "source"))).distinct()
    return nodes, d.select(key.alias("src_id"), to.alias("dst_id"))


def line_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Lines as a raw file would hold them, good and bad, in ``value``: a kind of line for each rest of the key by six."""
    c = table(spark, sf_dir, "customer")
    t = lambda *x: F.concat_ws("\t", *x)
    key, name, seg, bal, lit = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit
    p = F.concat(lit("p"), key)
    shapes = {
        "pages": (t(key, p, name, lit("text"), seg), t(lit("a"), key, name, lit("text"), seg), t(lit(" "), name, lit("x"), seg), t(lit("doc_id"), name, lit("x"), seg), lit(""), t(p, name, lit(""), seg)),
        "links": (t(key, F.concat(lit(" a"), key), F.concat(key, lit("b "))), t(lit("-"), key, name), t(key, lit(" ")), t(lit("src_id"), lit("dst_id")), t(key, name), t(key, name)),
        "words": (t(key, F.upper(seg)), lit("word"), lit("  "), *[F.concat(lit(" "), seg, key)] * 3),
        "clean_pages": (t(F.concat(lit(" "), p), name, lit("some words "), seg), t(p, name), t(p, name, lit("a b"), seg, lit("more"), lit("tabs")), t(lit("doc_id and more"), name, lit("x"), seg), p, t(p, name, lit(""), lit(""))),
        "ids": (F.concat(lit(" "), p, lit("\t")), lit(""), lit("   "), p, lit("twice"), p),
        "pred": (t(p, seg), t(lit("same"), seg), t(lit("doc_id"), lit("pred_category")), p, t(p, seg, lit("more")), t(F.concat(p, lit(" ")), F.concat(lit(" "), seg))),
        "queries": (t(p, name, seg), t(p, name), p, t(lit("query_id"), lit("query_text")), t(p, name, seg, lit("more")), t(F.concat(lit(" "), p), lit(""), seg)),
        "nodes": (t(p, name, lit("x"), seg), t(p, name, lit("x")), t(lit("doc_id"), lit("title"), lit("clean_text"), lit("label")), t(lit(" "), name, lit("x"), seg), t(p, name, lit("x"), seg, lit("y")), t(F.concat(lit(" "), p), lit(""), lit(""), lit(""))),
        "edges": (t(p, name), t(F.concat(lit(" "), p), F.concat(name, lit(" "))), t(p, name, seg), t(lit("src_id"), lit("dst_id")), t(p, lit(" ")), t(lit(""), name)),
        "topk": (t(p, name, bal, lit("1"), bal, lit("1")), t(p, name, bal, lit("0"), lit("no number"), lit("2")), t(lit("query_id"), lit("doc_id"), lit("a"), lit("b"), lit("c"), lit("rank")), t(p, name, bal, lit("1"), bal), t(p, lit(" "), bal, lit("1"), bal, lit("3")), t(F.concat(p, lit(" ")), name, bal, lit("1"), F.concat(lit(" "), bal), lit("4"))),
    }[kind]
    v = F.element_at(F.array(*shapes), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select(v.alias("value"))


def line_file(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The same lines in a folder of text files."""
    path = work_path(spark, f"lines-{kind}")
    line_table(spark, sf_dir, kind).write.text(path)
    return path
