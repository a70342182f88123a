"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canon(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canon, v)) + "]"
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR)
    mine = sorted(tuple(canon(r[c]) for c in sorted(got.columns)) for r in got.toPandas().to_dict("records"))
    if name in catalogue.SQL:
        want = con.execute(catalogue.SQL[name]).fetchdf()
        assert sorted(want.columns) == sorted(got.columns)
        assert mine == sorted(tuple(canon(r[c]) for c in sorted(want.columns)) for r in want.to_dict("records"))


def test_flagship(spark):
    assert catalogue.flagship(spark, DIR).count() == 20
