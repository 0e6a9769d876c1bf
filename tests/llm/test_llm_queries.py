"""Registered queries with SQL give its rows; queries and pipeline are registered."""

import os

import pytest
from oracle import connect, differences

from docparity.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_registered():
    import __spark_entry__ as entry

    names = [*QUERIES, "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(names) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
