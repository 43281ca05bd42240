"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from palisade.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.ORACLES)
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = duck.sql(registry.ORACLES[name])
    assert cols == sorted(sql.columns)
    at = [sql.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "first_us", "last_us", "count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
