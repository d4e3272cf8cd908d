"""Every query that has SQL gives the same rows in DuckDB, at sf0.001."""

import duckdb
import pytest

from granary import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_wide_digests(spark, tables):
    import hashlib

    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in core.QUERIES["digests_wide"](spark, SF).collect():
        body = texts[r["doc_id"]]
        assert [r[n] for n in ("sha224", "sha384", "sha512")] == [None if body is None else hashlib.new(n, body.encode()).hexdigest() for n in ("sha224", "sha384", "sha512")]


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, tables, name):
    got = core.QUERIES[name](spark, SF)
    want = tables.sql(core.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted(want.select(*columns).fetchall(), key=repr)
