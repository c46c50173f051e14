"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from stancewise.jobs import registry, reports  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


def compare(spark, name, call, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = call(spark, sf)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in want), key=repr)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:3])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_no_forbidden_import():
    root = os.path.join(os.path.dirname(__file__), "..", "stancewise")
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "llm" not in open(f).read(), f
