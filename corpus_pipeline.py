"""From raw documents to packed training sequences, in four stages that each apply one operator.

Language ID and quality rules drop what they reject, near-dedup keeps one document of each group,
packing turns what is left into sequences. A stage gets the table its predecessor wrote and returns
all columns of ``documents``; only the last one returns the packing's own rows.

Defined results: rows without text have no language and go; rows without doc_id are judged like any
other, never merged, and packed; of rows that share a doc_id and a text near-dedup keeps one; extra
columns of ``documents`` pass through, whatever their names; no documents give no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import langid, minhash, packing, quality
from rankloom.llm.queries import ship, vocabulary
from rankloom.llm.shared import work_folder

#: A language is rejected below this posterior.
LEAST_SCORE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside the text, so that no operator's column can clash with theirs."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language."""
    ship(spark)
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column can clash with the operator's own
    found = langid.predict(docs.toDF(*names), langid.fit(docs), text=names[docs.columns.index("text")])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*names).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the current policy."""
    return quality.apply_policy(quality.ledger(_rows(docs), keep=("row",))).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows that share an id are one document to the operator; of those with the same text one stays,
    found by partial aggregation, so that an id that very many rows have is no task's burden.
    """
    ship(spark)
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).filter("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    if not twice.limit(1).count():
        return kept
    row = F.struct(*docs.columns)
    texts = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("_h2")]
    again = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", *texts).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model and a tokenizer decide; SQL can't say the same. tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
