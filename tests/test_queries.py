"""Every query runs; those with SQL equal DuckDB's rows on the same files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from hearth.plans.catalogue import QUERIES, SQL

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 1


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["id", "price", "source", "n_changes", "previous_price"]


def test_registries_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
