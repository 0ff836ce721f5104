import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries of subpackages are tested beside them.
CORE = [n for n in QUERIES if QUERIES[n].__module__.startswith("lectorium.plans")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return int(value) if hasattr(value, "as_tuple") else value


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
