"""Hand-made cases for parsers, text rules, links, Naive Bayes, index, search, PageRank and fusion."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import classify, cleaning, fusion, graph, index, links, search
from rankloom.sources import sinks, tsv


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, f, value, *a):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"), *a)).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("{{a {{b}} c}} dd", "dd"),
        ('aa<ref name="x" /> keep <ref>gone</ref> bb', "aa bb"),
        ("[[price|$55 \\ yy]]", "55 yy"),
        ("[[File:x|see [[Aa|Bb]] foo]]", "see aa bb foo"),
        ("<p>hello</p>", "hello"),
        ("go http://e.com/a?x=1 www.e.com/y now", "go now"),
        ("", ""),
        (None, ""),
        ("line\none\ttwo", "line one two"),
    ],
)
def test_cleaning_rules(spark, raw, clean):
    assert one(spark, tx.clean_text, raw) == clean


def test_stopwords(spark):
    words = tsv.parse_word_lines(lines(spark, "the", "word", " ", "7\tAND"))
    assert got(words) == [("and",), ("the",)]
    pages = spark.createDataFrame([("1", "T", "the word is AND so", "x")], "doc_id string, title string, raw_text string, label string")
    assert cleaning.clean_pages(pages, words).first()["clean_text"] == "word is so"


def test_a_long_stopword_list_leaves_texts_with_their_pages(spark):
    rows = [(str(i), "T", f"page{i} stop{i} stays{i}", "x") for i in range(400)]
    pages = spark.createDataFrame(rows, "doc_id string, title string, raw_text string, label string").repartition(4)
    words = spark.createDataFrame([(f"stop{i}",) for i in range(3000)] + [(None,)], "word string")
    assert got(cleaning.clean_pages(pages, words).select("doc_id", "clean_text")) == sorted((str(i), f"page{i} stays{i}") for i in range(400))


def test_tokenizers_and_trim(spark):
    assert one(spark, tx.tokens_alpha, "A1 b2c dd 33") == ["dd"]
    assert one(spark, tx.tokens_alnum, "A1 b2c dd 33") == ["a1", "b2c", "dd", "33"]
    assert one(spark, tx.jtrim, "\t\x01 a b \n") == "a b"
    assert [one(spark, tx.is_integer, x) for x in ("12", "-1", "+1", "-", "", None, "1\n")] == [True, True, False, False, False, False, False]


def test_page_lines(spark):
    rows = tsv.parse_page_lines(lines(spark, "2\t10744\tT\tx\tArts", "a\tb\tc\td\te", "doc_id\tt\tr\tl", " \tt\tx\tl", "", "7\tT\t\tl"))
    assert got(rows) == [("10744", "T", "x", "Arts"), ("7", "T", "", "l")]


def test_lenient_readers(spark):
    pages = tsv.parse_clean_pages(lines(spark, "doc_idx\ta\tb\tc", "1\t t ", "2\ta\tb\tc\td"))
    assert got(pages) == [("1", "t", "", "UNKNOWN"), ("2", "a", "b", "c\td")]
    assert got(tsv.parse_pred_category(lines(spark, "doc_id\tx", "1\ta", "1\tb", "2"))) == [("1", "b")]
    assert got(tsv.parse_queries(lines(spark, "query_id\tx", "q1\thello"))) == [("q1", "hello", "")]
    assert got(tsv.parse_ids(lines(spark, " 1 ", "", "1", "2"))) == [("1",), ("2",)]
    assert got(tsv.parse_node_lines(lines(spark, " 1\ta\tb\tc", "1\ta\tb", "doc_id\ta\tb\tc"))) == [("1",)]
    assert got(tsv.parse_edge_lines(lines(spark, "1\t 2", "1\t", "1\t2\t3"))) == [("1", "2")]
    assert got(tsv.parse_retrieval_topk(lines(spark, "q\td\t1\t0\t1.5\t1", "q\td\t1\t0\tx\t1"))) == [("q", "d", 1.5)]


def test_links(spark):
    pages = spark.createDataFrame([("1",), ("2",), ("3",)], "doc_id string")
    raw = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "2"), ("2", "9"), ("3", "1")], "src_id string, dst_id string")
    s = links.link_stats(raw, pages).first()
    assert (s.links_before, s.links_after, s.removed_illegal_edges, s.removed_duplicate_edges) == (5, 2, 2, 1)
    assert got(links.clean_links(raw, pages)) == [("1", "2"), ("3", "1")]
    empty = links.link_stats(raw.limit(0), pages).first()
    assert (empty.links_before, empty.links_after, empty.removed_illegal_edges) == (0, 0, 0)


def brute_nb(train, tests, cnb):
    """train: (label, words); tests: {id: words}."""
    docs, cnt, tot = Counter(), {}, Counter()
    for label, ws in train:
        docs[label] += 1
        cnt.setdefault(label, Counter()).update(ws)
        tot.update(ws)
    v, all_ = len(tot), sum(tot.values())
    out = {}
    for d, ws in tests.items():
        scores = {}
        for c in docs:
            t = sum(cnt[c].values())
            p = math.log(docs[c] / sum(docs.values()))
            for w in ws:
                p += -math.log((tot[w] - cnt[c][w] + 1) / (all_ - t + v)) if cnb else math.log((cnt[c][w] + 1) / (t + v))
            scores[c] = p
        out[d] = scores
    return out


@pytest.mark.parametrize("algorithm", ["mnb", "cnb"])
def test_naive_bayes(spark, algorithm):
    rows = [("1", "", "red apple apple", "fruit"), ("2", "", "blue sky", "sky"), ("3", "", "red sky night", "sky"), ("4", "", "apple pie", "UNKNOWN"), ("5", "", "", "UNKNOWN"), ("6", "", "zzz unseen zzz", "UNKNOWN")]
    pages = spark.createDataFrame(rows, "doc_id string, title string, clean_text string, label string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    model = classify.train_nb(classify.train_pages(pages, ids("1", "2", "3", "4")))
    tests = classify.test_pages(pages, ids("4", "5", "6"))
    want = brute_nb([(r[3], r[2].split()) for r in rows[:3]], {r[0]: r[2].split() for r in rows[3:]}, algorithm == "cnb")
    for r in classify.nb_scores(model, tests, algorithm).collect():
        assert r.score == pytest.approx(want[r.doc_id][r.label], abs=1e-9)
    found = dict(got(classify.predict_nb(model, tests.union(tests.limit(1)), algorithm).distinct()))
    assert found["5"] == "sky"
    assert classify.predict_nb(model, tests.union(tests), algorithm).count() == 6
    report = classify.report_text(model, classify.predict_nb(model, tests, algorithm), "T").first()[0].split("\n")
    bar = "=" * 50
    assert report == [bar, "   T 文本分类报告", bar, "", "1. 训练文档数: 3", "2. 测试文档数: 3", "3. 词表大小:   5", "4. 类别列表:   fruit, sky", "", "5. 各预测类别数量:", *[f"     {c}: {n}" for c, n in sorted(Counter(found.values()).items(), key=lambda x: (-x[1], x[0]))], "", bar]
    with pytest.raises(ValueError):
        classify.nb_scores(model, tests, "svm")
    none = classify.train_nb(pages.limit(0))
    assert classify.predict_nb(none, tests, algorithm).count() == 0


def test_index_and_search(spark):
    rows = [("1", "t1", "apple banana", "Arts"), ("2", "t2", "apple apple cherry", "Sport"), ("3", "t3", "dog", "Arts")]
    pages = spark.createDataFrame(rows, "doc_id string, title string, clean_text string, category string")
    idf = dict(got(index.inverse_frequencies(pages)))
    assert idf["dog"] == pytest.approx(math.log(4 / 2) + 1)
    postings = index.build_index(pages)
    q = spark.createDataFrame([("a", "apple", "Art"), ("b", "apple apple", "none"), ("c", "apple", ""), ("d", "zzz", "")], "query_id string, query_text string, target_category string")
    top = {(r.query_id, r.doc_id): r for r in search.search(postings, q, 10).collect()}
    assert top["a", "1"].category_score == 1
    assert top["a", "2"].category_score == 0
    assert top["b", "2"].tfidf_score == pytest.approx(2 * top["a", "2"].tfidf_score, abs=2e-4)
    assert top["c", "2"].category_score == 1
    assert not any(k[0] == "d" for k in top)
    assert [r["rank"] for r in search.search(postings, q, 1).collect()] == [1, 1, 1]
    assert search.search(postings, q, 0).count() == 0
    twice = index.build_index(pages.union(pages.filter("doc_id = '3'")))
    assert twice.filter("term = 'dog'").count() == 2
    both = index.build_index(pages.union(spark.createDataFrame([("1", "t1", "apple", "Sport")], pages.schema)))
    hits = search.search(both, q, 10).filter("query_id = 'b' and doc_id = '1'").collect()
    assert [(r.category_score, r["rank"]) for r in hits] == [(0, 1)]  # one hit of a document that stands twice; its postings add up
    lists = dict(got(index.posting_lists(postings)))
    assert lists["apple"].startswith("1:1.2877:Arts;2:2.5754:Sport")


def brute_pagerank(nodes, edges, rounds, d=0.85):
    out = {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        mass = sum(v for n, v in r.items() if n not in out)
        into = Counter()
        for a, bs in out.items():
            for b in bs:
                into[b] += r.get(a, 0) / len(bs)
        r = {n: (1 - d) / len(nodes) + d * (into[n] + mass / len(nodes)) for n in nodes}
    return r


def test_pagerank(spark):
    nodes = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("4",)], "doc_id string")
    edges = [("1", "2"), ("2", "1"), ("2", "3"), ("4", "1"), ("4", "1")]
    df = spark.createDataFrame(edges, "src_id string, dst_id string")
    found = dict(got(graph.pagerank(nodes, df)))
    want = brute_pagerank(["1", "2", "3", "4"], edges, 10)
    assert found == pytest.approx(want)
    assert sum(found.values()) == pytest.approx(1.0)
    assert max(found.values()) == pytest.approx(0.3583426, abs=1e-7)
    assert set(dict(got(graph.pagerank(nodes, df, iterations=0))).values()) == {0.25}
    leak = graph.pagerank(nodes, spark.createDataFrame([("1", "99"), ("98", "1")], "src_id string, dst_id string"))
    assert graph.rank_mass(leak).first()[0] < 1
    assert got(graph.dangling_nodes(nodes, df)) == [("3",)]
    assert graph.pagerank(nodes.limit(0), df).count() == 0


def test_fusion(spark):
    top = spark.createDataFrame([("q", "9", 1.0), ("q", "10", 1.0), ("r", "9", 0.5), ("r", "404", 3.0)], "query_id string, doc_id string, retrieval_score double")
    ranks = spark.createDataFrame([("9", 0.2), ("10", 0.2)], "doc_id string, pagerank double")
    rows = {(r.query_id, r.doc_id): r for r in fusion.fuse_rank(top, ranks).collect()}
    assert rows["q", "10"]["rank"] == 1
    assert rows["q", "9"]["rank"] == 2
    assert rows["r", "9"].final_score == 1.0
    assert ("r", "404") not in rows


def test_sinks_and_command_line(spark, tmp_path, capsys):
    from rankloom.__main__ import parser, run

    w = lambda name, *rows: (tmp_path / name).write_text("\n".join(rows) + "\n") and str(tmp_path / name)
    pages = w("pages", "doc_id\ttitle\traw_text\tlabel", "1\tA\tred [[Apple|apple]]\tfruit", "2\tB\tblue sky\tsky", "3\tC\tapple pie\tUNKNOWN")
    links_ = w("links", "src_id\tdst_id", "1\t2", "2\t3", "3\t1", "3\t3", "1\t9")
    words, train, test = w("stop", "the"), w("train", "1", "2"), w("test", "3")
    queries = w("queries", "query_id\tquery_text\ttarget_category", "q1\tapple\tfruit")
    out = str(tmp_path / "out")
    go = lambda *a: run(spark, parser().parse_args([*a]))
    go("clean", pages, links_, words, out)
    assert (tmp_path / "out/clean_pages.tsv").read_text().split("\n")[0] == "doc_id\ttitle\tclean_text\tlabel"
    assert (tmp_path / "out/clean_stats.json").read_text() == '{\n  "pages_before": 3,\n  "pages_after": 3,\n  "links_before": 5,\n  "links_after": 3,\n  "removed_illegal_edges": 2,\n  "removed_duplicate_edges": 0\n}\n'
    said = capsys.readouterr().out.splitlines()
    assert said == ["[clean] stopwords loaded = 1", "[clean] pages: 3 -> 3", "[clean] links: 5 -> 3 (illegal=2, duplicate=0)"]
    go("classify", f"{out}/clean_pages.tsv", train, test, f"{out}/pred.tsv", f"{out}/report.txt")
    assert (tmp_path / "out/pred.tsv").read_text() == "doc_id\tpred_category\n3\tfruit\n"
    go("search", f"{out}/clean_pages.tsv", f"{out}/pred.tsv", queries, f"{out}/index.tsv", f"{out}/topk.tsv", "5")
    go("rank", f"{out}/clean_pages.tsv", f"{out}/clean_links.tsv", f"{out}/topk.tsv", out)
    said = capsys.readouterr().out.splitlines()
    assert said[:2] == ["[rank] N(nodes from clean_pages) = 3", "[rank] dangling nodes = 0"]
    assert said[2] == "[rank] iter= 1  danglingMass=0.000000  PRsum=1.000000"
    assert (len(said), said[-1]) == (13, "[rank] done.")
    final = (tmp_path / "out/final_rank.tsv").read_text().splitlines()
    assert final[0].split("\t") == ["query_id", "doc_id", "retrieval_score", "pagerank", "final_score", "rank"]
    assert [x.split("\t")[5] for x in final[1:]] == ["1", "2"]
    assert len((tmp_path / "out/pagerank.tsv").read_text().splitlines()) == 4
    sinks.save_tsv(spark.createDataFrame([("a", None)], "x string, y string"), f"{out}/many")


def test_a_file_longer_than_a_value_is_refused_at_once(spark, tmp_path):
    from rankloom.plans import queries

    for more in (0, 1):
        path = tmp_path / f"file{more}"
        with path.open("wb") as f:
            f.truncate(queries.LARGEST_VALUE + more)  # sparse
        if more:
            with pytest.raises(ValueError, match=f"{queries.LARGEST_VALUE + more} bytes"):
                queries._whole(spark, f"file://{path}")
        else:
            assert queries._whole(spark, f"file://{path}").columns == ["contents"]


def test_without_llm(spark, tmp_path):
    """With the llm folders gone, the entry module still imports and has the engine's queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "rankloom"), tmp_path / "rankloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'final_rank' in e.queries(); assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
