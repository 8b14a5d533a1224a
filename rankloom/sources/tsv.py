"""Readers of the tab-separated files, as parsers of a ``value`` column of lines.

Each ``parse_*`` takes lines and returns rows; each ``read_*`` does so for a path. Lines that don't
parse are dropped. Ids are strings. A parser that knows a header drops it by exact first field; the
lenient ones drop every line that starts with the header's first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_integer, jtrim


def lines(spark: SparkSession, path: str) -> DataFrame:
    r"""One row a line; \n, \r and \r\n end a line."""
    return spark.read.text(path)


def _fields(limit: int = -1) -> Column:
    return F.split(F.col("value"), "\t", limit)


def _numbered(df: DataFrame, width: int) -> DataFrame:
    """Lines of ``width`` fields, or of one more whose first is an integer row number, as ``f``."""
    d = df.filter("value is not null and value <> ''").withColumn("_f", _fields())
    with_number = (F.size("_f") == width + 1) & is_integer(F.get("_f", F.lit(0)))
    d = d.withColumn("f", F.when(with_number, F.slice("_f", 2, width)).when(F.size("_f") == width, F.col("_f")))
    return d.filter("f is not null").drop("_f")


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def parse_page_lines(df: DataFrame) -> DataFrame:
    """doc_id, title, raw_text, label; fields stay untrimmed, blank ids and the header go."""
    d = _numbered(df, 4).select(_at(0).alias("doc_id"), _at(1).alias("title"), _at(2).alias("raw_text"), _at(3).alias("label"))
    return d.filter((F.col("doc_id") != "doc_id") & (jtrim(F.col("doc_id")) != ""))


def parse_link_lines(df: DataFrame) -> DataFrame:
    """src_id, dst_id, both trimmed and not blank."""
    d = _numbered(df, 2).filter(_at(0) != "src_id").select(jtrim(_at(0)).alias("src_id"), jtrim(_at(1)).alias("dst_id"))
    return d.filter("src_id <> '' and dst_id <> ''")


def parse_word_lines(df: DataFrame) -> DataFrame:
    """word: of two fields whose first is an integer the second, else the first; lower case, without the header ``word``."""
    d = df.filter("value is not null").withColumn("f", _fields())
    w = F.when((F.size("f") == 2) & is_integer(_at(0)), _at(1)).otherwise(_at(0))
    return d.select(F.lower(jtrim(w)).alias("word")).filter("word not in ('', 'word')")


def parse_clean_pages(df: DataFrame) -> DataFrame:
    """doc_id, title, clean_text, label, trimmed; missing text is empty, a missing label ``UNKNOWN``; further tabs stay in the label."""
    d = df.filter(~F.col("value").startswith("doc_id")).withColumn("f", _fields(4))
    get = lambda i, missing: F.coalesce(jtrim(_at(i)), F.lit(missing))
    return d.select(get(0, "").alias("doc_id"), get(1, "").alias("title"), get(2, "").alias("clean_text"), get(3, "UNKNOWN").alias("label"))


def parse_ids(df: DataFrame) -> DataFrame:
    """Distinct doc_ids, one a line."""
    return df.select(jtrim(F.col("value")).alias("doc_id")).filter("doc_id <> ''").distinct()


def parse_pred_category(df: DataFrame) -> DataFrame:
    """doc_id, pred_category; of an id given twice the largest category, lines without a category dropped."""
    d = df.filter(~F.col("value").startswith("doc_id")).withColumn("f", _fields()).filter(F.size("f") >= 2)
    d = d.select(jtrim(_at(0)).alias("doc_id"), jtrim(_at(1)).alias("pred_category"))
    return d.groupBy("doc_id").agg(F.max("pred_category").alias("pred_category"))


def parse_queries(df: DataFrame) -> DataFrame:
    """query_id, query_text, target_category, trimmed; what is missing is empty."""
    d = df.filter(~F.col("value").startswith("query_id")).withColumn("f", _fields(3))
    get = lambda i: F.coalesce(jtrim(_at(i)), F.lit(""))
    return d.select(get(0).alias("query_id"), get(1).alias("query_text"), get(2).alias("target_category"))


def _exact(df: DataFrame, width: int, header: str) -> DataFrame:
    return df.withColumn("f", _fields()).filter((F.size("f") == width) & (_at(0) != header))


def parse_node_lines(df: DataFrame) -> DataFrame:
    """Trimmed doc_ids of lines with exactly four fields."""
    return _exact(df, 4, "doc_id").select(jtrim(_at(0)).alias("doc_id")).filter("doc_id <> ''")


def parse_edge_lines(df: DataFrame) -> DataFrame:
    """src_id, dst_id of lines with exactly two fields, trimmed, not blank."""
    d = _exact(df, 2, "src_id").select(jtrim(_at(0)).alias("src_id"), jtrim(_at(1)).alias("dst_id"))
    return d.filter("src_id <> '' and dst_id <> ''")


def parse_retrieval_topk(df: DataFrame) -> DataFrame:
    """query_id, doc_id, retrieval_score of lines with exactly six fields; a score that is no number drops the line."""
    d = _exact(df, 6, "query_id").select(jtrim(_at(0)).alias("query_id"), jtrim(_at(1)).alias("doc_id"), jtrim(_at(4)).try_cast("double").alias("retrieval_score"))
    return d.filter("query_id <> '' and doc_id <> '' and retrieval_score is not null")


def _reader(parse):
    return lambda spark, path: parse(lines(spark, path))


read_pages, read_links, read_words = _reader(parse_page_lines), _reader(parse_link_lines), _reader(parse_word_lines)
read_clean_pages, read_ids, read_pred_category, read_queries = _reader(parse_clean_pages), _reader(parse_ids), _reader(parse_pred_category), _reader(parse_queries)
read_nodes, read_edges, read_retrieval_topk = _reader(parse_node_lines), _reader(parse_edge_lines), _reader(parse_retrieval_topk)
