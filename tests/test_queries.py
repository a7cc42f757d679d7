"""Every registered query of the engine's own operators against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from packframe.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    return con


def _plain(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        at = [[d[0] for d in rel.description].index(c) for c in cols]
        assert len(rel.description) == len(cols)
        assert _plain(got) == _plain([tuple(r[i] for i in at) for r in rel.fetchall()])
