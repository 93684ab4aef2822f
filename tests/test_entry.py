"""The driver's contract, with and without the optional parts."""

import __spark_entry__ as entry
from leafmill.plans import registry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(registry.QUERIES) <= set(queries)
    assert set(oracles) <= set(queries)
    assert len(registry.ORACLES) > 90


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert {"page_id", "title", "overall", "is_reliable"} <= set(out.columns)
    assert out.count() == 50


def test_missing_parts_are_tolerated(monkeypatch):
    def absent(name):
        raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert set(entry.queries()) == set(registry.QUERIES)
    assert entry.oracle_sql() == registry.ORACLES
