"""Every registered detection query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from trackmend.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert columns == sorted(names)
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_every_query_without_sql_is_listed():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {
        "build_loose_tracks", "calibrate", "validate_corpus",
    }
