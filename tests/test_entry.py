import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [q for q in entry.queries() if q.startswith("q_")]


def comparable(rows):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql := entry.oracle_sql().get(name):
        db = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert comparable(map(tuple, rows)) == comparable(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "input", "term", "distance", "count", "rank"]
