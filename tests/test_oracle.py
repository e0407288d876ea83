"""Every registered query against its SQL in DuckDB."""

import glob
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

from oracle import oracle_sql  # noqa: E402
from reviewloom.plans.registry import REGISTRY as QUERIES  # noqa: E402

STATEMENTS = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(v, 9) if isinstance(v := r[i], float) else v for i in order) for r in rows)


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries())
    assert set(STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    cursor = duck.execute(STATEMENTS[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = bag(cursor.fetchall(), columns)
    assert bag(df.collect(), df.columns) == want
    assert want


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
