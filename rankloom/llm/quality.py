"""Quality rules as a ledger of failure bits, with DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for
each failed rule. A policy is a named, versioned mask of bits: applying another policy, or asking
what one rule alone removes, reads the ledger and never the texts again.

Defined results: a null or blank text has no words, so it fails ``few_words``; repeated rows and
repeated ids are judged row by row; other columns of the input are not touched (``ledger`` returns
only ``doc_id`` and what it measures); an empty table gives an empty ledger. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, failure as SQL over the measurements); the place in the list is the bit. Append only: ledgers keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("no_letters", "2 * n_letters < word_chars"),
]
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure removes a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": (*BASE, "symbols", "duplicate_lines", "word_length", "no_letters"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")


def mask(rules: tuple[str, ...]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``fail_bits`` for each row of ``docs``; a projection without any exchange.

    Repeated 3-word windows are found inside the row: the windows' 64-bit hashes are sorted with
    their places, equal neighbours are repeats, and the words they cover are the lengths of the
    union of ``[place, place + 3)``. Texts without a repeat stop after one pass over a hash set.
    """
    d = docs.select(*[F.col(k) for k in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_trim", F.expr(r"btrim(_t, ' \t\n\u000B\u000C\r')"))
    d = d.withColumn("_words", F.expr(r"if(_trim = '', cast(array() as array<string>), split(_trim, '[\\x20\\x09-\\x0D]+'))"))
    d = d.withColumn("_lines", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("_tri", F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])))"))
    d = d.select(
        *keep,
        "_tri",
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(_words, '')) as bigint)").alias("word_chars"),
        F.expr(r"cast(regexp_count(_t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr(r"cast(length(regexp_replace(_t, '[^\\p{L}]+', '')) as bigint)").alias("n_letters"),
    )
    d = d.withColumn("_sorted", F.expr("if(size(array_distinct(_tri)) < size(_tri), sort_array(transform(_tri, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    d = d.withColumn("_at", F.expr("sort_array(transform(filter(_sorted, (e, k) -> coalesce(get(_sorted, k - 1).h = e.h, false) or coalesce(get(_sorted, k + 1).h = e.h, false)), e -> e.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (a, x) -> a + x)"))
    bits = None
    for bit, (_, fails) in enumerate(RULES):
        b = F.when(F.expr(fails), F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        bits = b if bits is None else bits.bitwiseOR(b)
    # A filter on the bits must stay above them: pushed below, it would repeat every measurement wherever it is used.
    return d.select(*keep, *MEASURES).withColumn("fail_bits", F.when(F.spark_partition_id() >= 0, bits))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a ledger row has none of the policy's failures."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def apply_policy(ledger_df: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return ledger_df.withColumn("base_failed", ~passes("base")).withColumn("kept", passes(policy) & passes("base"))


def ablation(ledger_df: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail it, that only it removes, and that stay without it.

    The ledger is first summed by its distinct bit patterns (at most 2 to the number of rules, by
    partial aggregation), and every figure follows from those patterns by bit operations.
    """
    patterns = ledger_df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    spark = ledger_df.sparkSession
    names = [n for n, _ in RULES]
    table = spark.createDataFrame([(p, mask(r), x, 1 << names.index(x)) for p, r in POLICIES.items() for x in r], "policy string, _mask bigint, rule string, _bit bigint")
    hit = F.col("fail_bits").bitwiseAND(F.col("_mask"))
    return (
        patterns.join(F.broadcast(table))  # patterns x rules: bounded by the code, not by the data
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("_bit")) != 0, F.col("n")).otherwise(0)).cast("bigint").alias("n_failed"),
            F.sum(F.when(hit == F.col("_bit"), F.col("n")).otherwise(0)).cast("bigint").alias("n_only_here"),
            F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("_bit"))) == 0, F.col("n")).otherwise(0)).cast("bigint").alias("n_kept_without"),
        )
    )
