"""Every query with SQL against DuckDB on the same tables; the others run and give rows."""

import math
import os

import duckdb
import pytest

import docloom.plans.caches
import docloom.plans.documents
import docloom.plans.progress
import docloom.plans.retrieval
import docloom.plans.streams  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def same_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    cursor = duck.execute(ORACLES[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    assert same_order([tuple(plain(r[c]) for c in order) for r in rows]) == same_order([tuple(plain(r[cols.index(c)]) for c in order) for r in cursor.fetchall()])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
