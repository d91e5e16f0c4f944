"""Every query that SQL can express against DuckDB on the smallest driver tables."""

import os
import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(SQL)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def answers(spark):
    """All queries, several at a time: planning, not data, takes the time here."""

    def run(name):
        df = QUERIES[name](spark, FOLDER)
        order = sorted(df.columns)
        return order, sorted(repr(tuple(r[c] for c in order)) for r in df.collect())

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(answers, duck, name):
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    order = sorted(cols)
    want = sorted(repr(tuple(dict(zip(cols, r))[c] for c in order)) for r in cur.fetchall())
    assert answers[name].result() == (order, want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    plain = {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)}
    assert plain <= set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
