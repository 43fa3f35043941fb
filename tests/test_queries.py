"""Every query against its DuckDB oracle on sf0.001."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from tidewright.plans import checks, frames, measures, operations, shared, stories

DATA = "/root/testdata/sf0.001"
SQL = frames.SQL | shared.SQL | checks.SQL | stories.SQL | operations.SQL | measures.SQL
QUERIES = frames.QUERIES | shared.QUERIES | checks.QUERIES | stories.QUERIES | operations.QUERIES | measures.QUERIES


def plain(v):
    return round(v, 5) if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str) == want
