"""Each query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from auditlake.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(normal(dict(zip(names, r))[c]) for c in columns)) for r in cur.fetchall())


def test_entry_without_llm(data, spark, monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith(("auditlake.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("auditlake.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named '{name}'", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)
    assert e.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")
