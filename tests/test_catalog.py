"""Every catalogued query against its SQL in DuckDB."""

import duckdb
import pytest

from sablefin import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(names, rows):
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    if name in catalog.oracle_sql():
        found = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, got) == rows_of(names, found.fetchall())
