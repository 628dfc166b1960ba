"""The driver's contract."""

import os
import sys

import pytest

import __spark_entry__ as E


def test_names():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_engine_stands_without_the_training_data_operators(monkeypatch):
    for name in ("tessera.llm", "tessera.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # its import fails
    queries, sql = E.queries(), E.oracle_sql()
    assert len(queries) > 100 and not any(name.startswith("op") and name[2].isdigit() or name == "pipeline" for name in [*queries, *sql])
