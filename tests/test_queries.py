"""Every registered query runs, and gives the rows of its SQL."""

import math

import duckdb
import pytest

from corpusmill import registry
from corpusmill.sources.tables import TABLES

registry.load()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in registry.ORACLE_SQL:
        got = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        wanted = [dict(zip(names, r)) for r in got.fetchall()]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(r[c]) for c in columns) for r in wanted), key=repr)
