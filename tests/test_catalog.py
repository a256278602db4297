"""Every query that has SQL gives the rows of its SQL."""

from __future__ import annotations

import duckdb
import pytest

from lectern.plans.catalog import QUERIES
from lectern.plans.model_oracles import MODEL_SQL
from lectern.plans.model_queries import MODEL_QUERIES
from lectern.plans.oracles import SQL

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAMES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def views(folder):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(FOLDER)


@pytest.fixture(scope="module")
def duck_larger():
    return views(LARGER)


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(df, con, sql):
    columns = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert rows == want and rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, FOLDER), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(MODEL_QUERIES))
def test_model_query(spark, duck_larger, name):
    """The smallest tables have ten people, too few for the model's searches and lists."""
    same(MODEL_QUERIES[name](spark, LARGER), duck_larger, MODEL_SQL[name])


def test_search_code_counts_all_rows(spark):
    plan = QUERIES["search_code"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
