import importlib
import sys

import pytest


@pytest.mark.parametrize("missing", ["public_tokenizers", "corpus_pipeline", "veritable.llm"])
def test_the_other_queries_stand_without_what_the_corpus_operators_need(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith(("veritable.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert len(names) > 100 and set(entry.oracle_sql()) <= set(names)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]
