"""The entry stands a corpus part that is missing or cannot be imported."""

import importlib
import sys

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.registry import QUERIES


class Refuse:
    """Makes the import of some modules fail."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if name in self.names:
            raise ImportError(f"no {name}")
        return None


def without(monkeypatch, *names):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("railpulse.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Refuse(*names), *sys.meta_path])
    importlib.invalidate_caches()


def test_the_payment_queries_stay(monkeypatch):
    without(monkeypatch, "railpulse.llm", "corpus_pipeline")
    assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLE


def test_a_missing_library_of_the_corpus_part(monkeypatch):
    for missing in ("public_tokenizers", "railpulse.llm.registry"):
        with monkeypatch.context() as patch:
            patch.delitem(sys.modules, "public_tokenizers", raising=False)
            without(patch, missing)
            assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
