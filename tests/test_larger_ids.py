"""Registered queries whose lines are made of ids, on ids of larger tables, against their SQL; lookups that no task does alone."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.operators import lookups
from palisade.plans import registry

KINDS = ("view", "signup", "purchase", "click", "error")
IDS = (0, 7, 47, 63, 64, 120, 130, 255, 256, 1209, 1507, 65_535, 65_536, 65_537, 540_007)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids"))
    rows = [(i, dt.datetime(2024, 1, 3, i % 24, 30), user, kind, 1.0, "{}") for i, (user, kind) in enumerate((u, k) for u in IDS for k in KINDS)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["parse_audit", "normalise", "enrich_place", "lookup_country_range", "enrich_direction", "enrich_asset"])
def test_same_as_sql_on_larger_ids(spark, tables, name):
    df = registry.QUERIES[name](spark, tables)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    want = c.sql(f"SELECT {', '.join(f'\"{x}\"' for x in df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("longest", [False, True])
def test_ranges_are_told_to_rows_without_a_shuffle(spark, longest):
    rng = random.Random(3)
    ranges = [(lo, lo + rng.choice((0, 3, 500, 70_000, 5_000_000)), f"n{i}", i) for i, lo in enumerate(rng.randrange(1_000_000) for _ in range(60))] + [(9, 8, "none", -1)]
    rows = [(i, rng.randrange(1_200_000)) for i in range(400)] + [(400, None), (401, ranges[0][0])]
    df, table = spark.createDataFrame(rows, "id long, v long"), spark.createDataFrame(ranges, "lo long, hi long, name string, ord int")
    for told in (10_000, 20, 0):
        got = lookups.by_range(df, table, "v", "lo", "hi", "name", "ord", "id", 64, longest, told)
        want = {i: min(((h - lo if longest else 0, o, n) for lo, h, n, o in ranges if v is not None and lo <= v <= h), default=(None,))[-1] for i, v in rows}
        assert {r.id: r.name for r in got.select("id", F.col("name")).collect()} == {i: w for i, w in want.items()}, told
        if told == 10_000:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
