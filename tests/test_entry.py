import sys

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_package(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(e)
    assert "coverage" in again.queries() and not any(k.startswith("op") and k[2].isdigit() for k in again.queries())
    monkeypatch.undo()
    importlib.reload(e)
