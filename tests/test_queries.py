"""Every registered linkage query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from linkwright import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows or name in ("posterior_cuts",)
        return
    found = duck.execute(ORACLES[name])
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalogue.queries())
