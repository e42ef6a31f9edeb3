"""Every query that has SQL gives the rows that DuckDB gives for it; the others run."""

import math
import os

import duckdb
import pytest

from seglume import catalog
from seglume.session import TABLES

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{D}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if v is None else str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, D)
    got = table([tuple(r) for r in df.collect()], df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        found = db.execute(SQL[name])
        want = table(found.fetchall(), [c[0] for c in found.description])
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
        assert want[1] or name in catalog.MAY_BE_EMPTY
