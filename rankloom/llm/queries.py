"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, langid, licenses, minhash, multiindex, packing, pieces, quality, tokenbin, warc

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SENT: set[str] = set()
#: Rows of an Arrow batch: some MB of text, where Spark's default of 10,000 would be tens.
BATCH = 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither their path nor their folder has it.

    Batches that go to Python hold whole texts, so a session that hasn't chosen their rows gets BATCH.
    """
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, BATCH)
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if _ROOT in known or os.path.abspath(os.getcwd()) == _ROOT or spark.sparkContext.applicationId in _SENT:
        return
    import io
    import tempfile
    import zipfile

    target = os.path.join(tempfile.mkdtemp(prefix="rankloom-"), "rankloom.zip")  # Spark's file server deals it out
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "rankloom")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, _ROOT))
    spark.sparkContext.addPyFile(target)
    _SENT.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches", "passages")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_binary": op10_token_binary,
    "pipeline": pipeline,
}

_WHITE = r"[\x20\x09-\x0D]"
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_WHITE}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 3) AS o(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS wc,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             length(regexp_replace(t, '[^\pL]+', '', 'g')) AS n_letters FROM w),
a AS (SELECT m.doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_lines, n_dup_lines, n_letters,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN c ON m.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_letters < word_chars) AS kept
FROM b
"""


def _license_sql() -> str:
    cut = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    phrases = ", ".join(f"({words(p)}, '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({words(' '.join(dict.fromkeys(t.split())))}, '{label}', {len(t.split())})" for t, label in licenses.TEMPLATES)
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{cut}'), lambda x: x <> '') AS ws FROM d),
p(pw, label) AS (VALUES {phrases}),
tp(tw, label, n) AS (VALUES {templates}),
f AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, pw, label, unnest(range(1, len(ws) - len(pw) + 2)) AS i FROM w, p) WHERE ws[i : i + len(pw) - 1] = pw),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS bl FROM f GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(unnest(string_split(t, chr(10))), '{cut}'), lambda x: x <> '')) AS lw FROM d),
m AS (SELECT doc_id, label, len(list_intersect(lw, tw)) / len(tw) AS share FROM l, tp WHERE len(list_intersect(lw, tw)) >= ceil({licenses.THRESHOLD} * len(tw))),
t AS (SELECT doc_id, label, tw, ws[i : i + n - 1] AS part FROM (SELECT doc_id, ws, tw, label, n, unnest(range(1, len(ws) + 1)) AS i FROM w, tp WHERE len(list_intersect(tw, ws)) >= ceil({licenses.THRESHOLD} * len(tw)))),
o AS (SELECT doc_id, label, len(list_intersect(tw, part)) / len(tw) AS share FROM t WHERE len(list_intersect(tw, part)) >= ceil({licenses.THRESHOLD} * len(tw))),
s AS (SELECT doc_id, list(DISTINCT label) AS ml, max(share) AS share FROM (SELECT * FROM m UNION ALL SELECT * FROM o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN s ON w.doc_id = s.doc_id
"""


_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
r AS (SELECT page_id, n, s, max(page_id) OVER (PARTITION BY s) AS m FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= {warc.MIN_REVISIT} AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.MIN_REVISIT} AND m <> page_id THEN m END AS refers_to
FROM r
"""

_REACH = """r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)"""
_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM s x JOIN s y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.n > 0 AND y.n > 0
      WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.98),
{_REACH},
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WHITE}+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
      FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 1 THEN [1] ELSE range(1, len(ws)) END) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
{_REACH}
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_warc": _WARC,
    "op3_embedding_dedup": _VECTORS,
    "op7_minhash": _NEAR,
    "op5_quality_rules": _QUALITY,
    "op8_license_scan": _license_sql(),
}
