"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from trackloom import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    out = []
    for row in frame[names].itertuples(index=False):
        out.append(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return names, sorted(out, key=lambda row: str([round(v, 4) if isinstance(v, float) else v for v in row]))


def near(a, b):
    """Equal but for the last bits of a double: a difference in the last rounded digit is one."""
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    frame = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(frame.columns)
        return
    names, got = rows(frame)
    expected_names, expected = rows(db.sql(catalog.ORACLE_SQL[name]).df())
    assert names == expected_names
    assert len(got) == len(expected)
    assert all(near(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))
