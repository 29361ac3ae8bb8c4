"""The registry holds together, with and without the training-data operators."""

import importlib
import sys


def test_registry():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and "similarity_table" in queries


def test_without_training_data_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for name in [m for m in sys.modules if m.startswith("sigloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sigloom.llm", None)
    try:
        alone = importlib.reload(e)
        assert alone.queries() and not any(q.startswith("op") or q == "pipeline" for q in alone.queries())
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)


def test_flagship(spark, sf):
    import __spark_entry__ as e

    assert e.queries()["similarity_table"](spark, sf).count() > 0
