"""Multinomial and complement Naive Bayes over word counts, as DataFrame algebra.

Both scores sum a logarithm over every token of a document, words unseen in training included. An
unseen (word, class) pair adds ln 1 = 0 to the numerator, so only seen pairs need a join; what every
token shares, the denominator, is the document's length times one logarithm a class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_text, tokens_alpha
from ..storage import written

UNKNOWN = "UNKNOWN"
ALGORITHMS = ("mnb", "cnb")
#: Their names in reports.
TITLES = {"mnb": "Multinomial Naive Bayes", "cnb": "Complement Naive Bayes"}


def train_pages(pages: DataFrame, train_ids: DataFrame) -> DataFrame:
    """Pages with a known label whose id is in the list."""
    return pages.filter(F.col("label") != UNKNOWN).join(train_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def test_pages(pages: DataFrame, test_ids: DataFrame) -> DataFrame:
    return pages.join(test_ids.select("doc_id").distinct(), "doc_id", "left_semi")


@dataclass
class NaiveBayes:
    """classes: label, n_docs, log_prior, total; words: label, term, cnt; terms: term, tot; size: v, total_all."""

    classes: DataFrame
    words: DataFrame
    terms: DataFrame
    size: DataFrame


def train_nb(train: DataFrame) -> NaiveBayes:
    """Count documents, words and vocabulary of rows (label, title, clean_text), tokenized once into a table."""
    tokens = written(train.select("label", tokens_alpha(page_text()).alias("tokens")), "train")[0]
    words = tokens.select("label", F.explode("tokens").alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("cnt"))
    terms = words.groupBy("term").agg(F.sum("cnt").alias("tot"))
    by_class = tokens.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).cast("bigint").alias("total"))
    every = by_class.agg(F.sum("n_docs").alias("_all"))  # one row
    classes = by_class.join(F.broadcast(every)).withColumn("log_prior", F.log(F.col("n_docs") / F.col("_all"))).drop("_all")
    size = terms.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("tot"), F.lit(0)).alias("total_all"))
    return NaiveBayes(classes, words, terms, size)


def tokenized(pages: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the page's text) and tokens of every row, written once: lengths, counts and predictions all read this table."""
    return written(pages.select("doc_id", F.xxhash64(page_text()).alias("_h"), tokens_alpha(page_text()).alias("tokens")), "tokens")[0]


def nb_scores(model: NaiveBayes, pages: DataFrame, algorithm: str = "mnb") -> DataFrame:
    """doc_id, _h, label, score for each page and class; rows equal in id and text are one."""
    _known(algorithm)
    return _scores(model, tokenized(pages), algorithm)


def _known(algorithm: str) -> None:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} is none of {ALGORITHMS}")


def _scores(model: NaiveBayes, docs: DataFrame, algorithm: str) -> DataFrame:
    # Equal rows count their words _n times; dividing the sums by _n spares an exchange of the texts.
    heads = docs.groupBy("doc_id", "_h").agg(F.max(F.size("tokens")).alias("_len"), F.count(F.lit(1)).alias("_n"))
    tf = docs.select("doc_id", "_h", F.explode("tokens").alias("term")).groupBy("doc_id", "_h", "term").agg(F.count(F.lit(1)).alias("tf"))
    base = heads.join(model.classes.join(model.size))  # documents x classes: what is asked for
    key = ["doc_id", "_h", "label"]
    if algorithm == "mnb":
        seen = tf.join(model.words, "term").groupBy(*key).agg(F.sum(F.col("tf") * F.log(F.col("cnt") + 1)).alias("_seen"))
        score = F.col("log_prior") + F.coalesce("_seen", F.lit(0.0)) / F.col("_n") - F.col("_len") * F.log(F.col("total") + F.col("v"))
        return base.join(seen, key, "left").select(*key, score.alias("score"))
    both = tf.join(model.terms, "term")
    every = both.groupBy("doc_id", "_h").agg(F.sum(F.col("tf") * F.log(F.col("tot") + 1)).alias("_every"))
    less = F.log(F.col("tot") - F.col("cnt") + 1) - F.log(F.col("tot") + 1)
    seen = both.join(model.words, "term").groupBy(*key).agg(F.sum(F.col("tf") * less).alias("_seen"))
    score = F.col("log_prior") - ((F.coalesce("_every", F.lit(0.0)) + F.coalesce("_seen", F.lit(0.0))) / F.col("_n") - F.col("_len") * F.log(F.col("total_all") - F.col("total") + F.col("v")))
    return base.join(every, ["doc_id", "_h"], "left").join(seen, key, "left").select(*key, score.alias("score"))


def predict_nb(model: NaiveBayes, pages: DataFrame, algorithm: str = "mnb") -> DataFrame:
    """doc_id, pred_category, a row for each row of ``pages``; ties go to the label that sorts first. No classes, no rows."""
    _known(algorithm)
    docs = tokenized(pages)
    best = Window.partitionBy("doc_id", "_h").orderBy(F.round("score", 6).desc(), "label")
    chosen = _scores(model, docs, algorithm).withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("doc_id", "_h", F.col("label").alias("pred_category"))
    return docs.select("doc_id", "_h").join(chosen, ["doc_id", "_h"]).select("doc_id", "pred_category")


def nb_report(predictions: DataFrame) -> DataFrame:
    """pred_category and how many rows got it."""
    return predictions.groupBy("pred_category").agg(F.count(F.lit(1)).alias("n"))


#: The report's lines, in order; the counts stand where {counts} is, five spaces before each.
REPORT = ("{bar}", "   {title} 文本分类报告", "{bar}", "", "1. 训练文档数: {trained}", "2. 测试文档数: {tested}", "3. 词表大小:   {v}", "4. 类别列表:   {labels}", "", "5. 各预测类别数量:", "{counts}", "", "{bar}")


def report_text(model: NaiveBayes, predictions: DataFrame, title: str) -> DataFrame:
    """The report in one ``value``; classes by name, counts from the largest. All inputs have a row a class at most."""
    counts = nb_report(predictions).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pred_category", "n"))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("tested"))
    train = model.classes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("trained"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))
    values = {
        "bar": F.lit("=" * 50),
        "title": F.lit(title),
        "counts": F.array_join(F.transform("c", lambda x: F.concat(F.lit("     "), x["pred_category"], F.lit(": "), x["n"])), "\n"),
    }
    parts: list = []
    for line in REPORT:
        before, _, rest = line.partition("{")
        name, _, after = rest.partition("}")
        parts.append(F.concat(F.lit(before), values.get(name, F.col(name) if name else F.lit("")).cast("string"), F.lit(after)))
    return train.join(model.size).join(counts).select(F.concat_ws("\n", *parts).alias("value"))
