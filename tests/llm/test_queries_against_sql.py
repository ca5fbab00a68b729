"""Every llm query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tokenloom.llm.queries import QUERIES
from tokenloom.llm.sql import SQL
from tests.comparing import duck, same_rows

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    same_rows(QUERIES[name](spark, DIRECTORY), duck(DIRECTORY).sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DIRECTORY)
    assert rows.count() > 0 and len(rows.columns) > 0


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} | {"p7"} == {f"p{i}" for i in range(1, 11)}
    assert glob.glob(os.path.join(DIRECTORY, "*.parquet"))
