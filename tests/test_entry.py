"""The entry works whether or not the optional modules can be imported."""

import importlib
import sys

import pytest

entry = importlib.import_module("__spark_entry__")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("module", ["xxhash", "pyarrow", "basketry.llm"])
def test_relational_queries_without_a_module(monkeypatch, module):
    pytest.importorskip("basketry.llm")
    for name in [m for m in sys.modules if m.startswith("basketry.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, module, None)
    assert set(entry.queries()) == set(entry.registry.queries())
    assert set(entry.oracle_sql()) == set(entry.registry.oracle_sql())
