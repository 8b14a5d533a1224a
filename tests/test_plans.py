"""What the physical plans must and must not hold."""

import os
import re

import pytest

from rankloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_text_markup", "nb_predict_mnb", "nb_predict_cnb", "inverted_index", "retrieval_topk_boosted", "link_stats", "final_rank", "e2e_search"])
def test_stays_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan(spark, name))


def test_top_k_is_cut_before_the_exchange(spark):
    assert plan(spark, "retrieval_topk_boosted").count("WindowGroupLimit") >= 2  # below the exchange and above it


def test_scans_read_what_is_used(spark):
    p = plan(spark, "clean_text_documents")
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", p)) == {"doc_id:bigint,text:string"}
    assert all("text" not in s for s in re.findall(r"labels[^\n]*ReadSchema: struct<([^>]*)>", plan(spark, "nb_predict_mnb")))


def test_counts_are_partial_before_the_exchange(spark):
    p = plan(spark, "nb_word_counts")
    assert p.count("partial_count") >= 1


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull" in plan(spark, "links_valid")


def test_the_row_of_a_whole_file_is_held_once(spark):
    """It comes from an exchange, with nothing above that copies it and no projection below."""
    top, below = plan(spark, "file_clean_pages").strip().splitlines()[-2:]
    assert "Exchange SinglePartition" in top or "Exchange RoundRobinPartitioning(1)" in top
    assert re.search(r"FileScan text \[contents#\d+\]", below)


def test_a_whole_file_is_read_letter_by_letter(spark, tmp_path):
    from rankloom.plans import queries

    for text in ("x", "a\r\nb\rc\n\n", " \u20ac\t\U0001f600 no end of line", "\n"):
        (tmp_path / "file").write_bytes(text.encode())
        assert [tuple(r) for r in queries._whole(spark, f"file://{tmp_path}/file").collect()] == [(text,)]
