"""Every registered query that has SQL gives the rows of its SQL; the others run and have rows."""

import os

import pytest
from oracle import connect, differences

from docparity.plans.queries import FLAGSHIP, ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert FLAGSHIP(spark, SF).columns == ["lang", "level", "docs", "avg_score"]


@pytest.mark.parametrize("gone", ["corpus_pipeline", "docparity.llm", "zstandard"])
def test_entry_without_the_optional_part(monkeypatch, gone):
    import importlib
    import sys

    for name in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline", "zstandard") or m.startswith("docparity.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    del sys.modules["__spark_entry__"]
