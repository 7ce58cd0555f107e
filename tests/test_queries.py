"""Every core query against its SQL, and the driver contract."""

import sys

import pytest

import __spark_entry__ as entry
from twinsift import queries as core
from tests.check import same_rows

QUERIES, SQL = core.queries(), core.oracle_sql()
ROWS_ONLY = {"name_ratio", "near_pairs", "name_bigram_pairs", "why_keep", "duplicate_story", "export_nested", "ann_topk", "near_clusters", "cluster_validate", "all_groups"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(QUERIES[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_every_query_has_sql_or_a_reason(spark):
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    """A missing library costs the queries that need it, not the core."""
    for name in [m for m in sys.modules if m.startswith("twinsift.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("zstandard", "tiktoken"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(QUERIES) <= set(entry.queries())
