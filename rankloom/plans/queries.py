"""One query for each observable operator, over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, cleaning, fusion, graph, index, links, search
from ..sources import datasets as ds
from ..sources import sinks, tsv
from ..storage import delete, length, work_path

K = 10
#: Bytes that one value of Spark can hold: its longest row, less what a row of one field has besides.
LARGEST_VALUE = 2**31 - 16 - 16


def _raw(spark: SparkSession, sf: str, what: str) -> DataFrame:
    d = ds.pages(spark, sf)
    return d.select("doc_id", F.posexplode(what_tokens(what)).alias("at", "term"))


def what_tokens(what: str):
    return tx.tokens_alpha(tx.page_text()) if what == "alpha" else tx.tokens_alnum(tx.page_text())


def _counts(spark: SparkSession, sf: str, what: str) -> DataFrame:
    return _raw(spark, sf, what).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _model(spark: SparkSession, sf: str) -> classify.NaiveBayes:
    return classify.train_nb(classify.train_pages(ds.pages(spark, sf), ds.train_ids(spark, sf)))


def _predict(spark: SparkSession, sf: str, algorithm: str) -> DataFrame:
    return classify.predict_nb(_model(spark, sf), classify.test_pages(ds.pages(spark, sf), ds.test_ids(spark, sf)), algorithm)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their true language as category."""
    d = ds.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("clean_text"), F.col("lang").alias("category"))


def _topk(spark: SparkSession, sf: str, boost: float) -> DataFrame:
    return search.search(index.build_index(_labelled(spark, sf)), ds.search_queries(spark, sf), K, boost)


def _six(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


def clean_text_documents(spark, sf):
    return ds.table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), ds.STOPWORDS).alias("clean_text"))


def clean_text_markup(spark, sf):
    return cleaning.clean_pages(ds.marked_up_pages(spark, sf), ds.stopwords(spark))


def clean_text_html(spark, sf):
    return ds.table(spark, sf, "pages").select("page_id", tx.clean_text(F.col("html")).alias("clean_text"))


def stopword_filter(spark, sf):
    t = _raw(spark, sf, "alnum").withColumnRenamed("term", "word")
    return cleaning.stopword_filter(t.select("doc_id", "word"), ds.stopwords(spark)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def link_stats(spark, sf):
    n, e = ds.page_links(spark, sf)
    return links.link_stats(e, n)


def links_valid(spark, sf):
    n, e = ds.page_links(spark, sf)
    return links.valid_links(e, n)


def links_distinct(spark, sf):
    n, e = ds.page_links(spark, sf)
    return links.clean_links(e, n)


def nb_report(spark, sf):
    return classify.nb_report(_predict(spark, sf, "mnb"))


def final_label(spark, sf):
    return index.final_label(ds.pages(spark, sf), _predict(spark, sf, "mnb")).select("doc_id", "label", "category")


def inverted_index(spark, sf):
    return _six(index.build_index(_labelled(spark, sf)), "tfidf")


def posting_lists(spark, sf):
    return index.posting_lists(index.build_index(_labelled(spark, sf)))


def pagerank_events(rounds: int):
    return lambda spark, sf: graph.pagerank(*ds.events_graph(spark, sf), iterations=rounds).select("doc_id", F.round("pagerank", 10).alias("pagerank"))


def pagerank_mass(spark, sf):
    return graph.rank_mass(graph.pagerank(*ds.parts_graph(spark, sf), iterations=3)).select(F.round("mass", 8).alias("mass"))


def out_degree(spark, sf):
    return graph.out_degrees(ds.events_graph(spark, sf)[1])


def adjacency(spark, sf):
    return graph.adjacency(ds.events_graph(spark, sf)[1]).select("src_id", F.array_join("neighbours", ",").alias("neighbours"))


def dangling_nodes(spark, sf):
    return graph.dangling_nodes(*ds.events_graph(spark, sf))


def _candidates(spark, sf):
    ranks = graph.pagerank(*ds.document_graph(spark, sf), iterations=2)
    return _topk(spark, sf, search.BOOST), ranks


def minmax_norm(spark, sf):
    top, ranks = _candidates(spark, sf)
    n = fusion.normalised(top.select("query_id", "doc_id", "retrieval_score").join(ranks, "doc_id"))
    return n.select("query_id", "doc_id", F.round("norm_retrieval", 6).alias("norm_retrieval"), F.round("norm_pagerank", 6).alias("norm_pagerank"))


def final_rank(spark, sf):
    return fusion.fuse_rank(*_candidates(spark, sf))


def e2e_search(spark, sf):
    from .engine import classify_and_search

    return classify_and_search(ds.pages(spark, sf), ds.train_ids(spark, sf), ds.test_ids(spark, sf), ds.search_queries(spark, sf), k=K)[2]


def _whole(spark, path: str) -> DataFrame:
    """A file's contents, letter by letter, in one row; a file too long for that is refused before executors try to hold it."""
    if (size := length(spark, path)) > LARGEST_VALUE:
        raise ValueError(f"{path} is written whole, but its {size} bytes are more than the {LARGEST_VALUE} that one value can hold")
    held = spark.read.schema("contents string").text(path, wholetext=True)
    return held.repartition(1)  # a row that comes from an exchange is as long as its value; the reader's buffers, several times as long, stay in another task


def _saved(spark, save) -> DataFrame:
    path = work_path(spark, "file")
    save(path)
    return _whole(spark, path)


def file_clean_pages(spark, sf):
    """A cleaned table as one file, header first, in order of the id."""
    pages = cleaning.clean_pages(ds.marked_up_pages(spark, sf), ds.stopwords(spark))
    return _saved(spark, lambda path: sinks.save_single_tsv(pages, path, "doc_id"))


def file_parts(spark, sf):
    """A folder of part files: its lines but for the headers."""
    path = work_path(spark, "parts")
    sinks.save_tsv(ds.table(spark, sf, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")), path)
    return spark.read.text(path).filter("value <> 'c_custkey\tc_name\tc_mktsegment'").select(F.col("value").alias("line"))


def file_stats(spark, sf):
    n, e = ds.page_links(spark, sf)
    return _saved(spark, lambda path: sinks.save_text(sinks.stats_json(links.link_stats(e, n)), path))


def file_report(spark, sf):
    model = _model(spark, sf)
    found = classify.predict_nb(model, classify.test_pages(ds.pages(spark, sf), ds.test_ids(spark, sf)), "mnb")
    return _saved(spark, lambda path: sinks.save_text(classify.report_text(model, found, classify.TITLES["mnb"]), path))


def file_index(spark, sf):
    lists = index.posting_lists(index.build_index(_labelled(spark, sf)))
    return _saved(spark, lambda path: sinks.save_single_tsv(lists, path, "term"))


def file_pagerank(spark, sf):
    """Ranks with eight decimals."""
    ranks = graph.pagerank(*ds.events_graph(spark, sf), iterations=2)
    return _saved(spark, lambda path: sinks.save_single_tsv(ranks.select("doc_id", sinks.number("pagerank", 8).alias("pagerank")), path, "doc_id"))


def file_replaced(spark, sf):
    """A file that is there already is replaced; what another path held is deleted."""
    path, gone = work_path(spark, "file"), work_path(spark, "gone")
    regions = ds.table(spark, sf, "region")
    sinks.save_single_tsv(regions, gone, "r_regionkey")
    sinks.save_single_tsv(ds.table(spark, sf, "nation"), path, "n_nationkey")
    sinks.save_single_tsv(regions, path, "r_regionkey")
    deleted = delete(spark, gone) and not delete(spark, gone)
    return _whole(spark, path).withColumn("deleted", F.lit(deleted))


def run_pipeline(spark, sf):
    """Raw pages and links to the fused ranking in one call."""
    from .engine import run_pipeline as run

    label = F.when(F.col("_known"), F.col("label")).otherwise(F.lit("UNKNOWN"))
    known = ds.train_ids(spark, sf).distinct().withColumn("_known", F.lit(True))
    raw = ds.marked_up_pages(spark, sf).join(known, "doc_id", "left").select("doc_id", "title", "raw_text", label.alias("label"))
    edges = ds.document_graph(spark, sf)[1]
    return run(raw, edges, ds.stopwords(spark), ds.train_ids(spark, sf), ds.test_ids(spark, sf), ds.search_queries(spark, sf), algorithm="cnb", k=K, iterations=5).final


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "e2e_search": e2e_search,
    "clean_text_documents": clean_text_documents,
    "clean_text_markup": clean_text_markup,
    "clean_text_html": clean_text_html,
    "parse_page_lines": lambda s, sf: tsv.parse_page_lines(ds.line_table(s, sf, "pages")),
    "parse_link_lines": lambda s, sf: tsv.parse_link_lines(ds.line_table(s, sf, "links")),
    "parse_stopwords": lambda s, sf: tsv.parse_word_lines(ds.line_table(s, sf, "words")),
    "read_clean_pages": lambda s, sf: tsv.read_clean_pages(s, ds.line_file(s, sf, "clean_pages")),
    "read_ids": lambda s, sf: tsv.read_ids(s, ds.line_file(s, sf, "ids")),
    "read_pred_category": lambda s, sf: tsv.read_pred_category(s, ds.line_file(s, sf, "pred")),
    "read_queries": lambda s, sf: tsv.read_queries(s, ds.line_file(s, sf, "queries")),
    "read_nodes": lambda s, sf: tsv.read_nodes(s, ds.line_file(s, sf, "nodes")),
    "read_edges": lambda s, sf: tsv.read_edges(s, ds.line_file(s, sf, "edges")),
    "read_retrieval_topk": lambda s, sf: tsv.read_retrieval_topk(s, ds.line_file(s, sf, "topk")),
    "file_clean_pages": file_clean_pages,
    "file_parts": file_parts,
    "file_stats": file_stats,
    "file_report": file_report,
    "file_index": file_index,
    "file_pagerank": file_pagerank,
    "file_replaced": file_replaced,
    "run_pipeline": run_pipeline,
    "stopword_filter": stopword_filter,
    "links_valid": links_valid,
    "links_distinct": links_distinct,
    "link_stats": link_stats,
    "tokens_alpha": lambda s, sf: _counts(s, sf, "alpha"),
    "tokens_alnum": lambda s, sf: _counts(s, sf, "alnum"),
    "nb_priors": lambda s, sf: _six(_model(s, sf).classes.select("label", "n_docs", "log_prior"), "log_prior"),
    "nb_class_totals": lambda s, sf: _model(s, sf).classes.select("label", "total"),
    "nb_word_counts": lambda s, sf: _model(s, sf).words,
    "nb_word_totals": lambda s, sf: _model(s, sf).terms.select("term", F.col("tot").cast("bigint").alias("tot")),
    "nb_vocab_size": lambda s, sf: _model(s, sf).size.select("v", F.col("total_all").cast("bigint").alias("total_all")),
    "nb_predict_mnb": lambda s, sf: _predict(s, sf, "mnb"),
    "nb_predict_cnb": lambda s, sf: _predict(s, sf, "cnb"),
    "nb_report": nb_report,
    "final_label": final_label,
    "tf": lambda s, sf: index.term_frequencies(_labelled(s, sf)),
    "df": lambda s, sf: index.document_frequencies(_labelled(s, sf)),
    "idf": lambda s, sf: _six(index.inverse_frequencies(_labelled(s, sf)), "idf"),
    "tfidf": lambda s, sf: _six(index.tfidf(_labelled(s, sf)), "tfidf"),
    "inverted_index": inverted_index,
    "posting_lists": posting_lists,
    "retrieval_topk": lambda s, sf: _topk(s, sf, 0.0),
    "retrieval_topk_boosted": lambda s, sf: _topk(s, sf, search.BOOST),
    "adjacency": adjacency,
    "out_degree": out_degree,
    "dangling_nodes": dangling_nodes,
    "pagerank_1": pagerank_events(1),
    "pagerank_10": pagerank_events(10),
    "pagerank_mass": pagerank_mass,
    "minmax_norm": minmax_norm,
    "final_rank": final_rank,
}

# -- the same in SQL ------------------------------------------------------------------------------
_STOP = "[" + ", ".join(f"'{w}'" for w in ds.STOPWORDS) + "]"


def _clean(x: str, stop: str = "[]") -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern, replacement in tx.CLEANING:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"array_to_string(list_filter(string_split(trim({out}), ' '), lambda w: length(w) >= 2 AND NOT list_contains({stop}::VARCHAR[], w)), ' ')"


def _tok(x: str, kept: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^{kept}]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)"


_PAGES = """pages_ AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, source AS title, text AS clean_text, lang AS category,
    CASE WHEN l.doc_id IS NOT NULL THEN lang ELSE 'UNKNOWN' END AS label, source || ' ' || text AS t
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)"""
_ALPHA = f"alpha AS (SELECT doc_id, label, unnest({_tok('t', 'a-z')}) AS term FROM pages_)"
_ALNUM = f"alnum AS (SELECT doc_id, unnest({_tok('t', 'a-z0-9')}) AS term FROM pages_)"
_NB = f"""{_PAGES}, {_ALPHA},
train AS (SELECT * FROM pages_ WHERE label <> 'UNKNOWN'),
words AS (SELECT label, term, count(*) AS cnt FROM alpha WHERE label <> 'UNKNOWN' GROUP BY ALL),
terms AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS tot FROM words GROUP BY term),
classes AS (SELECT t.label, count(*) AS n_docs, ln(count(*) / (SELECT count(*) FROM train)) AS log_prior FROM train t GROUP BY t.label),
totals AS (SELECT label, CAST(sum(cnt) AS BIGINT) AS total FROM words GROUP BY label),
size AS (SELECT count(*) AS v, CAST(sum(tot) AS BIGINT) AS total_all FROM terms)"""


def _nb_predict(cnb: bool) -> str:
    seen = "-ln((coalesce(tot, 0) - coalesce(cnt, 0) + 1) / (total_all - total + v))" if cnb else "ln((coalesce(cnt, 0) + 1) / (total + v))"
    return f"""{_NB},
tf AS (SELECT doc_id, term, count(*) AS n FROM alpha WHERE label = 'UNKNOWN' GROUP BY ALL),
s AS (SELECT tf.doc_id, c.label, sum(n * {seen}) AS s FROM tf CROSS JOIN classes c JOIN totals USING (label) CROSS JOIN size
      LEFT JOIN words w ON w.label = c.label AND w.term = tf.term LEFT JOIN terms ON terms.term = tf.term GROUP BY ALL),
p AS (SELECT d.doc_id, c.label, round(log_prior + coalesce(s, 0), 6) AS score FROM (SELECT doc_id FROM pages_ WHERE label = 'UNKNOWN') d CROSS JOIN classes c LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = c.label),
pred AS (SELECT doc_id, label AS pred_category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS k FROM p) WHERE k = 1)"""


_FINAL = "final AS (SELECT p.doc_id, p.label, CASE WHEN p.label = 'UNKNOWN' THEN coalesce(pred_category, 'UNKNOWN') ELSE p.label END AS category FROM pages_ p LEFT JOIN pred ON p.doc_id = pred.doc_id)"
_INDEX = """tf_ AS (SELECT doc_id, term, count(*) AS tf FROM alnum GROUP BY ALL),
df_ AS (SELECT term, count(DISTINCT doc_id) AS df FROM alnum GROUP BY term),
idf_ AS (SELECT term, ln(((SELECT count(*) FROM pages_) + 1) / (df + 1)) + 1 AS idf FROM df_),
ti AS (SELECT doc_id, tf_.term, tf * idf AS tfidf FROM tf_ JOIN idf_ ON tf_.term = idf_.term)"""


def _search(category: str, boost: float) -> str:
    """CTEs from ``ti`` and a table with doc_id and category on to ``top``."""
    target = "[" + ", ".join(f"'{x}'" for x in ds.TARGETS) + "][CAST(item_id % 4 + 1 AS INT)]"
    return f"""q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {target} AS target, unnest({_tok('text', 'a-z0-9')}) AS term FROM benchmark),
m AS (SELECT query_id, ti.doc_id, max(category) AS category, target, sum(tfidf) AS s FROM q JOIN ti ON q.term = ti.term JOIN {category} c ON c.doc_id = ti.doc_id GROUP BY query_id, ti.doc_id, target),
sc AS (SELECT *, CAST(contains(category, target) AS INT) AS category_score, round(s + {boost} * CAST(contains(category, target) AS INT), 6) AS r FROM m),
top AS (SELECT query_id, doc_id, round(s, 4) AS tfidf_score, category_score, round(r, 4) AS retrieval_score, CAST(rank AS INT) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, doc_id) AS rank FROM sc) WHERE rank <= {K})"""


_EVENT_LINKS = """steps AS (SELECT CAST(e.user_id AS VARCHAR) AS src_id, CAST(f.user_id AS VARCHAR) AS dst_id FROM events e JOIN events f ON f.event_id = e.event_id + 1),
types AS (SELECT CAST(user_id AS VARCHAR) AS src_id, event_type AS dst_id FROM events)"""
_EVENTS = f"""{_EVENT_LINKS},
nodes AS (SELECT DISTINCT doc_id FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id FROM events UNION ALL SELECT event_type FROM events)),
edges AS (SELECT DISTINCT src_id, dst_id FROM (SELECT * FROM steps UNION ALL SELECT * FROM types))"""
_PARTS = """edges AS (SELECT DISTINCT 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id FROM lineitem),
nodes AS (SELECT DISTINCT doc_id FROM (SELECT src_id AS doc_id FROM edges UNION ALL SELECT dst_id FROM edges))"""
_DOC_LINKS = """raw_edges AS (SELECT CAST(doc_id AS VARCHAR) AS src_id, unnest([CAST(doc_id + 1 AS VARCHAR), CAST(doc_id // 2 AS VARCHAR), 'source ' || source]) AS dst_id FROM documents)"""
_DOCS = f"""{_DOC_LINKS},
nodes AS (SELECT DISTINCT doc_id FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents UNION ALL SELECT 'source ' || source FROM documents)),
edges AS (SELECT DISTINCT src_id, dst_id FROM raw_edges)"""
_LINKS = f"""{_EVENT_LINKS}, n AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc_id FROM events),
e AS (SELECT * FROM steps UNION ALL SELECT * FROM types UNION ALL SELECT dst_id, src_id FROM types),
v AS (SELECT * FROM e WHERE src_id <> dst_id AND src_id IN (SELECT doc_id FROM n) AND dst_id IN (SELECT doc_id FROM n))"""


def _ranks(rounds: int) -> str:
    """CTEs from nodes and edges on to r<rounds>, a step for each round."""
    out = ["deg AS MATERIALIZED (SELECT src_id, count(*) AS n FROM edges GROUP BY src_id)", "r0 AS MATERIALIZED (SELECT doc_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pr FROM nodes)"]
    for k in range(rounds):
        out.append(f"""r{k + 1} AS MATERIALIZED (SELECT x.doc_id, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(i, 0) +
    (SELECT coalesce(sum(pr), 0) FROM r{k} WHERE doc_id NOT IN (SELECT src_id FROM deg)) / (SELECT count(*) FROM nodes)) AS pr
    FROM nodes x LEFT JOIN (SELECT dst_id, sum(pr / n) AS i FROM edges JOIN deg USING (src_id) JOIN r{k} ON r{k}.doc_id = src_id GROUP BY dst_id) y ON y.dst_id = x.doc_id)""")
    return ",\n".join(out)


_FUSE = """b AS (SELECT query_id, top.doc_id, retrieval_score, pr AS pagerank FROM top JOIN r2 ON top.doc_id = r2.doc_id),
w AS (SELECT *, min(retrieval_score) OVER q AS r0_, max(retrieval_score) OVER q AS r1_, min(pagerank) OVER q AS p0_, max(pagerank) OVER q AS p1_ FROM b WINDOW q AS (PARTITION BY query_id)),
nm AS (SELECT *, CASE WHEN r1_ = r0_ THEN 1.0::DOUBLE ELSE (retrieval_score - r0_) / (r1_ - r0_) END AS nr, CASE WHEN p1_ = p0_ THEN 1.0::DOUBLE ELSE (pagerank - p0_) / (p1_ - p0_) END AS np FROM w),
f AS (SELECT *, round(0.75::DOUBLE * nr + 0.25::DOUBLE * np, 6) AS final_score FROM nm)"""
_FINAL_ROWS = "SELECT query_id, doc_id, round(retrieval_score, 6) AS retrieval_score, round(pagerank, 8) AS pagerank, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS INT) AS rank FROM f"
_FUSED = f"{_PAGES}, {_ALNUM}, {_INDEX}, {_search('pages_', search.BOOST)}, {_DOCS}, {_ranks(2)}, {_FUSE}"
# Of raw pages the cleaned text is what counts, and of links those between pages.
_RAW = f"""raw_ AS (SELECT *, @RAW@ AS raw FROM documents),
pages_ AS (SELECT *, title || ' ' || clean_text AS t FROM (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, source AS title, {_clean('raw', _STOP)} AS clean_text, lang AS category,
    CASE WHEN l.doc_id IS NOT NULL THEN lang ELSE 'UNKNOWN' END AS label FROM raw_ d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id))"""
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _lines(kind: str) -> str:
    """CTE l: the fields ``f`` and the whole line ``line`` of each line that ``datasets.line_table`` gives."""
    t = lambda *x: "concat_ws(chr(9), " + ", ".join(x) + ")"
    key, name, seg, bal = "CAST(c_custkey AS VARCHAR)", "c_name", "c_mktsegment", "CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR)"
    p = f"'p' || {key}"
    cases = {
        "pages": [t(key, p, name, "'text'", seg), t("'a'", key, name, "'text'", seg), t("' '", name, "'x'", seg), t("'doc_id'", name, "'x'", seg), "''", t(p, name, "''", seg)],
        "links": [t(key, f"' a' || {key}", f"{key} || 'b '"), t("'-'", key, name), t(key, "' '"), t("'src_id'", "'dst_id'"), t(key, name), t(key, name)],
        "words": [t(key, f"upper({seg})"), "'word'", "'  '", *[f"' ' || {seg} || {key}"] * 3],
        "clean_pages": [t(f"' ' || {p}", name, "'some words '", seg), t(p, name), t(p, name, "'a b'", seg, "'more'", "'tabs'"), t("'doc_id and more'", name, "'x'", seg), p, t(p, name, "''", "''")],
        "ids": [f"' ' || {p} || chr(9)", "''", "'   '", p, "'twice'", p],
        "pred": [t(p, seg), t("'same'", seg), t("'doc_id'", "'pred_category'"), p, t(p, seg, "'more'"), t(f"{p} || ' '", f"' ' || {seg}")],
        "queries": [t(p, name, seg), t(p, name), p, t("'query_id'", "'query_text'"), t(p, name, seg, "'more'"), t(f"' ' || {p}", "''", seg)],
        "nodes": [t(p, name, "'x'", seg), t(p, name, "'x'"), t("'doc_id'", "'title'", "'clean_text'", "'label'"), t("' '", name, "'x'", seg), t(p, name, "'x'", seg, "'y'"), t(f"' ' || {p}", "''", "''", "''")],
        "edges": [t(p, name), t(f"' ' || {p}", f"{name} || ' '"), t(p, name, seg), t("'src_id'", "'dst_id'"), t(p, "' '"), t("''", name)],
        "topk": [t(p, name, bal, "'1'", bal, "'1'"), t(p, name, bal, "'0'", "'no number'", "'2'"), t("'query_id'", "'doc_id'", "'a'", "'b'", "'c'", "'rank'"), t(p, name, bal, "'1'", bal), t(p, "' '", bal, "'1'", bal, "'3'"), t(f"{p} || ' '", name, bal, "'1'", f"' ' || {bal}", "'4'")],
    }[kind]
    when = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases))
    return f"l AS (SELECT line, string_split(line, chr(9)) AS f FROM (SELECT CASE c_custkey % 6 {when} END AS line FROM customer))"


def _t(i: int, missing: str = "''") -> str:
    """The trimmed field i (from 1), or a value where the line has none."""
    return f"coalesce({_TRIM.format(f'f[{i}]')}, {missing})"


def _report_sql() -> str:
    values = {"bar": f"'{'=' * 50}'", "title": f"'{classify.TITLES['mnb']}'", "trained": "(SELECT CAST(sum(n_docs) AS BIGINT) FROM classes)", "tested": "(SELECT count(*) FROM pred)", "v": "(SELECT v FROM size)", "labels": "(SELECT string_agg(label, ', ' ORDER BY label) FROM classes)", "counts": "(SELECT string_agg('     ' || pred_category || ': ' || n, chr(10) ORDER BY n DESC, pred_category) FROM (SELECT pred_category, count(*) AS n FROM pred GROUP BY pred_category))"}
    lines = []
    for line in classify.REPORT:
        before, _, rest = line.partition("{")
        name, _, after = rest.partition("}")
        lines.append(f"'{before}' || " + (values[name] if name else "''") + f" || '{after}'")
    return f"WITH {_nb_predict(False)} SELECT concat_ws(chr(10), {', '.join(lines)}) || chr(10) AS contents"


def _file(header: str, line: str, table: str, order: str) -> str:
    """The contents of one file: header, then lines in an order."""
    return f"SELECT '{header}'.replace('|', chr(9)) || chr(10) || string_agg({line} || chr(10), '' ORDER BY {order}) AS contents FROM {table}"


def _fields(width: int) -> str:
    return f"g AS (SELECT CASE WHEN len(f) = {width + 1} AND regexp_matches(f[1], '^-?[0-9]+$') THEN f[2:] WHEN len(f) = {width} THEN f END AS f FROM l)"


_LABELLED = f"{_PAGES}, {_ALNUM}, {_INDEX}"
_LISTS = "SELECT term, string_agg(ti.doc_id || ':' || printf('%.4f', tfidf) || ':' || category, ';' ORDER BY ti.doc_id, category) AS posting_list FROM ti JOIN pages_ p ON p.doc_id = ti.doc_id GROUP BY term"
_MARKED = """'{{Infobox|x}} ' || text || ' [[Aa|Bee $5 \\ x]] [[Cee]] <ref name="q">gone</ref> <ref name=z /> <b>kept</b> http://e.com/x?y=1 www.e.com/y end'"""

ORACLES: dict[str, str] = {
    "e2e_search": f"WITH {_nb_predict(False)}, {_FINAL}, {_ALNUM}, {_INDEX}, {_search('final', search.BOOST)} SELECT * FROM top",
    "clean_text_documents": f"SELECT doc_id, {_clean('text', _STOP)} AS clean_text FROM documents",
    "clean_text_markup": f"WITH {_RAW.replace('@RAW@', _MARKED)} SELECT doc_id, title, clean_text, category AS label FROM pages_",
    "clean_text_html": f"SELECT page_id, {_clean('html')} AS clean_text FROM pages",
    "parse_page_lines": f"WITH {_lines('pages')}, {_fields(4)} SELECT f[1] AS doc_id, f[2] AS title, f[3] AS raw_text, f[4] AS label FROM g WHERE f IS NOT NULL AND f[1] <> 'doc_id' AND {_TRIM.format('f[1]')} <> ''",
    "parse_link_lines": f"WITH {_lines('links')}, {_fields(2)} SELECT {_TRIM.format('f[1]')} AS src_id, {_TRIM.format('f[2]')} AS dst_id FROM g WHERE f IS NOT NULL AND f[1] <> 'src_id' AND {_TRIM.format('f[1]')} <> '' AND {_TRIM.format('f[2]')} <> ''",
    "parse_stopwords": f"WITH {_lines('words')} SELECT lower({_TRIM.format('w')}) AS word FROM (SELECT CASE WHEN len(f) = 2 AND regexp_matches(f[1], '^-?[0-9]+$') THEN f[2] ELSE f[1] END AS w FROM l) WHERE lower({_TRIM.format('w')}) NOT IN ('', 'word')",
    "read_clean_pages": f"WITH {_lines('clean_pages')} SELECT {_t(1)} AS doc_id, {_t(2)} AS title, {_t(3)} AS clean_text, CASE WHEN len(f) >= 4 THEN {_TRIM.format('array_to_string(f[4:], chr(9))')} ELSE 'UNKNOWN' END AS label FROM l WHERE NOT starts_with(line, 'doc_id')",
    "read_ids": f"WITH {_lines('ids')} SELECT DISTINCT {_TRIM.format('line')} AS doc_id FROM l WHERE {_TRIM.format('line')} <> ''",
    "read_pred_category": f"WITH {_lines('pred')} SELECT {_t(1)} AS doc_id, max({_t(2)}) AS pred_category FROM l WHERE NOT starts_with(line, 'doc_id') AND len(f) >= 2 GROUP BY 1",
    "read_queries": f"WITH {_lines('queries')} SELECT {_t(1)} AS query_id, {_t(2)} AS query_text, {_TRIM.format('array_to_string(f[3:], chr(9))')} AS target_category FROM l WHERE NOT starts_with(line, 'query_id')",
    "read_nodes": f"WITH {_lines('nodes')} SELECT {_t(1)} AS doc_id FROM l WHERE len(f) = 4 AND f[1] <> 'doc_id' AND {_t(1)} <> ''",
    "read_edges": f"WITH {_lines('edges')} SELECT {_t(1)} AS src_id, {_t(2)} AS dst_id FROM l WHERE len(f) = 2 AND f[1] <> 'src_id' AND {_t(1)} <> '' AND {_t(2)} <> ''",
    "read_retrieval_topk": f"WITH {_lines('topk')} SELECT {_t(1)} AS query_id, {_t(2)} AS doc_id, TRY_CAST({_t(5)} AS DOUBLE) AS retrieval_score FROM l WHERE len(f) = 6 AND f[1] <> 'query_id' AND {_t(1)} <> '' AND {_t(2)} <> '' AND TRY_CAST({_t(5)} AS DOUBLE) IS NOT NULL",
    "file_clean_pages": f"WITH {_RAW.replace('@RAW@', _MARKED)} " + _file("doc_id|title|clean_text|label", "concat_ws(chr(9), doc_id, title, clean_text, category)", "pages_", "doc_id"),
    "file_parts": "SELECT concat_ws(chr(9), CAST(c_custkey AS VARCHAR), c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS line FROM customer",
    "file_stats": f"""WITH {_LINKS}, c AS (SELECT (SELECT count(*) FROM n) AS p, (SELECT count(*) FROM e) AS b, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS d)
SELECT concat_ws(chr(10), '{{', '  "pages_before": ' || p || ',', '  "pages_after": ' || p || ',', '  "links_before": ' || b || ',', '  "links_after": ' || d || ',', '  "removed_illegal_edges": ' || (b - v) || ',', '  "removed_duplicate_edges": ' || (v - d), '}}', '') AS contents FROM c""",
    "file_report": _report_sql(),
    "file_index": f"WITH {_LABELLED}, lists AS ({_LISTS}) " + _file("term|posting_list", "term || chr(9) || posting_list", "lists", "term"),
    "file_pagerank": f"WITH {_EVENTS}, {_ranks(2)} " + _file("doc_id|pagerank", "doc_id || chr(9) || printf('%.8f', pr)", "r2", "doc_id"),
    "file_replaced": "SELECT *, true AS deleted FROM (" + _file("r_regionkey|r_name", "r_regionkey || chr(9) || r_name", "region", "r_regionkey") + ")",
    "run_pipeline": f"WITH {_nb_predict(True).replace(_PAGES, _RAW.replace('@RAW@', _MARKED))}, {_FINAL}, {_ALNUM}, {_INDEX}, {_search('final', search.BOOST)}, {_DOC_LINKS}, nodes AS (SELECT DISTINCT doc_id FROM pages_), edges AS (SELECT DISTINCT src_id, dst_id FROM raw_edges WHERE src_id <> dst_id AND dst_id IN (SELECT doc_id FROM nodes)), {_ranks(5)}, {_FUSE.replace('r2', 'r5')} {_FINAL_ROWS}",
    "stopword_filter": f"WITH {_PAGES}, {_ALNUM} SELECT doc_id, term AS word, count(*) AS n FROM alnum WHERE NOT list_contains({_STOP}, term) GROUP BY ALL",
    "links_valid": f"WITH {_LINKS} SELECT src_id, dst_id FROM v",
    "links_distinct": f"WITH {_LINKS} SELECT DISTINCT src_id, dst_id FROM v",
    "link_stats": f"""WITH {_LINKS}, c AS (SELECT (SELECT count(*) FROM n) AS p, (SELECT count(*) FROM e) AS b, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS d)
SELECT p AS pages_before, p AS pages_after, b AS links_before, d AS links_after, b - v AS removed_illegal_edges, v - d AS removed_duplicate_edges FROM c""",
    "tokens_alpha": f"WITH {_PAGES}, {_ALPHA} SELECT doc_id, term, count(*) AS n FROM alpha GROUP BY ALL",
    "tokens_alnum": f"WITH {_PAGES}, {_ALNUM} SELECT doc_id, term, count(*) AS n FROM alnum GROUP BY ALL",
    "nb_priors": f"WITH {_NB} SELECT label, n_docs, round(log_prior, 6) AS log_prior FROM classes",
    "nb_class_totals": f"WITH {_NB} SELECT label, total FROM totals",
    "nb_word_counts": f"WITH {_NB} SELECT label, term, cnt FROM words",
    "nb_word_totals": f"WITH {_NB} SELECT term, tot FROM terms",
    "nb_vocab_size": f"WITH {_NB} SELECT v, total_all FROM size",
    "nb_predict_mnb": f"WITH {_nb_predict(False)} SELECT doc_id, pred_category FROM pred",
    "nb_predict_cnb": f"WITH {_nb_predict(True)} SELECT doc_id, pred_category FROM pred",
    "nb_report": f"WITH {_nb_predict(False)} SELECT pred_category, count(*) AS n FROM pred GROUP BY pred_category",
    "final_label": f"WITH {_nb_predict(False)}, {_FINAL} SELECT doc_id, label, category FROM final",
    "tf": f"WITH {_LABELLED} SELECT doc_id, term, tf FROM tf_",
    "df": f"WITH {_LABELLED} SELECT term, df FROM df_",
    "idf": f"WITH {_LABELLED} SELECT term, round(idf, 6) AS idf FROM idf_",
    "tfidf": f"WITH {_LABELLED} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM ti",
    "inverted_index": f"WITH {_LABELLED} SELECT term, ti.doc_id, round(tfidf, 6) AS tfidf, category FROM ti JOIN pages_ p ON p.doc_id = ti.doc_id",
    "posting_lists": f"WITH {_LABELLED} {_LISTS}",
    "retrieval_topk": f"WITH {_LABELLED}, {_search('pages_', 0.0)} SELECT * FROM top",
    "retrieval_topk_boosted": f"WITH {_LABELLED}, {_search('pages_', search.BOOST)} SELECT * FROM top",
    "adjacency": f"WITH {_EVENTS} SELECT src_id, string_agg(dst_id, ',' ORDER BY dst_id) AS neighbours FROM edges GROUP BY src_id",
    "out_degree": f"WITH {_EVENTS} SELECT src_id, count(*) AS out_degree FROM edges GROUP BY src_id",
    "dangling_nodes": f"WITH {_EVENTS} SELECT doc_id FROM nodes WHERE doc_id NOT IN (SELECT src_id FROM edges)",
    "pagerank_1": f"WITH {_EVENTS}, {_ranks(1)} SELECT doc_id, round(pr, 10) AS pagerank FROM r1",
    "pagerank_10": f"WITH {_EVENTS}, {_ranks(10)} SELECT doc_id, round(pr, 10) AS pagerank FROM r10",
    "pagerank_mass": f"WITH {_PARTS}, {_ranks(3)} SELECT round(sum(pr), 8) AS mass FROM r3",
    "minmax_norm": f"WITH {_FUSED} SELECT query_id, doc_id, round(nr, 6) AS norm_retrieval, round(np, 6) AS norm_pagerank FROM nm",
    "final_rank": f"WITH {_FUSED} {_FINAL_ROWS}",
}
