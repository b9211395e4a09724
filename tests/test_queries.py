"""Every registered query runs; every one with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import __spark_entry__
import pytest
from compare import connect, difference
from conftest import SF

from papyra.plans import contracts, nested_packed, relational, sequences, storage, texts, views

MODULES = [relational, views, contracts, sequences, texts, storage, nested_packed]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_points_agree(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0


def test_no_module_outside_llm_imports_it():
    from conftest import ROOT

    for p in (ROOT / "papyra").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "papyra.llm" not in p.read_text(), p
