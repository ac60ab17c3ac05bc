"""Corpus queries with SQL give what DuckDB gives."""

import math
import os
from collections import Counter

import duckdb
import pytest

from quadrille.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    df = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(x) for x in r) for r in cursor.fetchall())
    assert Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect()) == want
