"""Every registered query with SQL gives what DuckDB gives."""

import math
import os
from collections import Counter

import duckdb
import pytest

from quadrille import graph_queries, queries

QUERIES = queries.queries() | graph_queries.queries()
SQL = queries.oracle_sql() | graph_queries.oracle_sql()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(x) for x in r) for r in cursor.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    assert got == want


def test_equal_suppliers_keep_their_rows(spark, con, tmp_path):
    """Smallest names as SQL finds them; suppliers of one nation that share a name stay two rows."""
    path = f"{tmp_path}/supplier.parquet"
    con.execute(f"copy (select i::bigint as s_suppkey, 'S' || i % 7 as s_name, (i % 3)::int as s_nationkey, 1.5::double as s_acctbal from range(1, 40) r(i)) to '{path}' (format parquet)")
    want = con.execute(SQL["r18_equality"].replace("from supplier", f"from '{path}'")).fetchall()
    got = QUERIES["r18_equality"](spark, str(tmp_path)).select("s", "name").collect()
    assert len(want) == 39 and Counter(map(tuple, got)) == Counter(want)


def test_entry_imports_without_corpus(monkeypatch):
    """The entry module works where the corpus folder is gone."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("quadrille.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quadrille.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", blocked)
    entry = importlib.import_module("__spark_entry__")
    assert "j01_join_chain" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__")
