"""Every registered query against its SQL, on the smallest data."""

import sys

import pytest

import __spark_entry__ as entries
from checks.compare import compare, connect
from checks.registry import QUERIES
from tests.conftest import FOLDER

RUNS = {name: run for name, run in entries.queries().items() if name in QUERIES}
TEXTS = entries.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(RUNS) == set(QUERIES) and set(RUNS) <= set(TEXTS)


def test_entries_work_without_the_text_operators(monkeypatch):
    for missing in ("corpus_pipeline", "tidewatch.llm"):
        for name in [m for m in sys.modules if m == missing or m.startswith(f"{missing}.")]:
            monkeypatch.delitem(sys.modules, name)
        with monkeypatch.context() as context:
            context.setattr(sys, "meta_path", [_Missing(missing), *sys.meta_path])
            assert set(entries.queries()) == set(QUERIES) == set(entries.oracle_sql())


class _Missing:
    """Finds that a module isn't there."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None


def test_flagship_query(spark):
    result = entries.entry(spark)
    assert result.columns == ["dive_site", "species", "sighting_count", "frequency_rank"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, connection, name):
    same, note = compare(spark, connection, FOLDER, name, RUNS[name], TEXTS.get(name))
    assert same, note
