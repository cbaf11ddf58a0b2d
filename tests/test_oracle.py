"""Every core query with an SQL twin against DuckDB on the small tables, and the registry itself."""

import importlib

import pytest

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
CORE = {k: f for m in MODULES for k, f in m.QUERIES.items()}
TWINS = {k: s for m in MODULES for k, s in m.ORACLE.items()}


def test_registry():
    assert set(TWINS) <= set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, data, same_rows, name):
    assert same_rows(CORE[name](spark, data).toPandas(), duck.execute(TWINS[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(TWINS)))
def test_rows_only(spark, data, name):
    assert CORE[name](spark, data).count() > 0
