"""Registered queries against the same question in SQL, at the smallest scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from frames import TESTDATA
from rowmend.plans import catalog, oracles

FOLDER = f"{TESTDATA}/sf0.001"
QUERIES, SQL = catalog.all_queries(), oracles.all_oracles()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return ""
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = engine.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert mine == canonical(cursor.fetchall(), columns)
    assert mine[1]
