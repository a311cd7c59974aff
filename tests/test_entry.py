import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lakeloom.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lakeloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    names = e.queries()
    assert "agg_01_group_by" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
