"""Every registered query of the library against DuckDB on the smallest tables."""

import math
from datetime import datetime

import duckdb
import pytest

from cadenza.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    v = float(v)
    return None if math.isnan(v) else float(f"{v:.9g}") + 0.0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall()) == rows
