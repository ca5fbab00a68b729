"""Every core query against DuckDB on the smallest tables; those without SQL must run."""

import pytest

from tests.comparing import duck, same_rows
from tokenloom.plans.catalog import QUERIES, SQL

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    same_rows(QUERIES[name](spark, DIRECTORY), duck(DIRECTORY).sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIRECTORY).count() > 0


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_optional():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tokenloom"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "tokenloom.llm" not in file.read_text()
