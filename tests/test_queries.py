"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemill.queries import ORACLE_SQL, QUERIES, entry

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.split('.')[0]} as select * from '{FOLDER}/{t}'")
    df = QUERIES[name](spark, FOLDER)
    got = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", ["residual_significance", "residual_p_values"])
def test_residuals_without_cold_days(spark, name, tmp_path):
    """On larger tables no day's mean is under 10 degrees, so one variable is 0 on every day."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (20 + o_custkey % 20 as o_custkey) from '{FOLDER}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    ours = sorted(tuple(map(norm, r)) for r in df.collect())
    got = con.execute(ORACLE_SQL[name])
    at = [[c[0] for c in got.description].index(c) for c in df.columns]
    assert ours == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
    assert "nan" in [v for r in ours for v in r]


def test_entry(spark):
    rows = entry(spark, FOLDER).collect()
    assert rows and all(math.isfinite(r.predicted) for r in rows)


def test_whole_job(spark):
    from tidemill.operators.daily import STATISTICS
    from tidemill.plans import forecast as plan
    from tidemill.sources.readers import order_days

    n = plan.matrix(order_days(spark, FOLDER)).count()
    rows = entry(spark, FOLDER).groupBy("horizon").count().collect()
    assert {r.horizon: r["count"] for r in rows} == dict.fromkeys(range(1, 11), n - 90 + 1 - 10)  # every origin
    windows = len(range(0, n - 130 + 1, 14))
    assert {r.total_slots for r in QUERIES["elastic_net_selection"](spark, FOLDER).collect()} == {10 * windows}
    sql = ORACLE_SQL["get_daily_statistics_all_days"]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
    columns = ["date", "metric", "site", *STATISTICS]
    theirs = con.execute(sql)
    at = [[c[0] for c in theirs.description].index(c) for c in columns]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in theirs.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in QUERIES["get_daily_statistics_all_days"](spark, FOLDER).collect()), key=str) == theirs
