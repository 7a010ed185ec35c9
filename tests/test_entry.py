"""The driver's contract without the optional corpus operators."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from kmerloom.plans import registry


@pytest.mark.parametrize("missing", [("kmerloom.llm.queries", "corpus_pipeline"), ("corpus_pipeline",)])
def test_what_cannot_be_imported_is_left_out(monkeypatch, missing):
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)
    queries = entry.queries()
    assert set(registry.queries()) <= set(queries) and "pipeline" not in queries
    assert set(entry.oracle_sql()) <= set(queries)
    if len(missing) == 2:
        assert set(queries) == set(registry.queries())
