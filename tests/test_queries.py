"""Every registered query against its SQL on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from gazette.workload import QUERIES, SQL

# the only query that runs Python in its tasks: scoring with a user's model
PYTHON = {"batch_score"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def normal(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        answer = duck.execute(SQL[name])
        names = [c[0] for c in answer.description]
        assert sorted(df.columns) == sorted(names)
        assert normal(rows, df.columns) == normal(answer.fetchall(), names)


def test_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
