"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestrata.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, tmp_path, name):
    df = QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    if name not in ORACLES:
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
        return
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = db.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    want = db.sql(f"SELECT {columns} FROM ({ORACLES[name]})")
    assert got.columns == want.columns
    key = lambda rows: sorted(rows, key=repr)
    assert key(got.fetchall()) == key(want.fetchall())
