"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from driftloom.plans import detector, problems, queries

DATA = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **detector.QUERIES, **problems.QUERIES}
SQL = {**queries.SQL, **detector.SQL, **problems.SQL}
NAMES = [n for n in QUERIES if n in SQL]
#: Queries that run at the same time: on small tables they are bound by the number of jobs, not by their size.
AT_ONCE = 6

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def table(frame):
    frame = frame[sorted(frame.columns)]
    def norm(v):
        if pd.isna(v):
            return ""
        return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(v) if isinstance(v, str) else f"{float(v):.4f}"

    return list(frame.columns), sorted(tuple(norm(v) for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def results(spark):
    """Every query's rows, or the error it ended with."""

    def one(name):
        try:
            return QUERIES[name](spark, DATA).toPandas()
        except Exception as e:
            return e

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(NAMES, pool.map(one, NAMES)))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(results, duck, name):
    if isinstance(results[name], Exception):
        raise results[name]
    assert table(results[name]) == table(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    """Queries without SQL have tests of their own; here they give rows of the columns that they promise."""
    q = QUERIES[name](spark, DATA)
    assert q.limit(1).count() == 1 and len(set(q.columns)) == len(q.columns)
