"""Every query with SQL gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from skeinworks.plans import catalog, catalog_more, catalog_rest  # noqa: F401

SF = Path("/root/testdata/sf0.001")


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return str([one(x) for x in v]) if isinstance(v, list | tuple) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, str(SF))
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0
