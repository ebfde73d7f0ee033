"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import duckdb
import pytest

from veritrail.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    plain = lambda r: repr([round(x, 9) if isinstance(x, float) else x for x in r])
    want = sorted(plain([row[i] for i in order]) for row in cursor.fetchall())
    assert sorted(plain(r) for r in got.select(*columns).collect()) == want
