import glob
import os

import duckdb
import pytest

from lectorium.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

COLUMNS = {
    "p1_found": ["field", "row_id"], "p2_found": ["page_id", "kind"], "p3_found": ["chunk_id", "sentence_end"], "p4_found": ["query_id", "chunk_id"], "p5_found": ["chunk_id_a", "chunk_id_b"], "p6_found": ["field", "id_a", "id_b"],
    "p7_found": ["page_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p8_ids":
            assert len(set(map(tuple, rows))) == len(rows)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = QUERIES[name](spark, DATA)
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())
