"""Queries against their SQL on the small test tables."""

import os

import oracle
import pytest

from rankloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert oracle.compare(spark, oracle.connect(SF), QUERIES[name], ORACLES[name], SF) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in QUERIES
