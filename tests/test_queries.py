"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from stowage import queries as core
from stowage import queries_formats  # noqa: F401  it registers its queries with core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return made


def plain(v):
    return bytes(v) if isinstance(v, bytearray) else None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    got = core.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = got.collect()
    if name not in core.ORACLE_SQL:
        assert rows
        return
    sql = con.execute(core.ORACLE_SQL[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in sql.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())
