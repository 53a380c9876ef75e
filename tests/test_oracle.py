"""Every registered engine query against its SQL in DuckDB."""

import hashlib
import os
from threading import Timer

import duckdb
import pytest

from tidelog.plans.queries import QUERIES, SQL


def canon(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    mine = sorted(repr([canon(r[n]) for n in names]) for r in df.collect())
    theirs = sorted(repr([canon(r[i]) for i in at]) for r in relation.fetchall())
    assert mine == theirs


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def told_over_long_log(spark, path, name, seed, piece):
    """The query over a log of one partition with 100,000 records, each of them hashed; a run that makes all the texts is cancelled."""
    ids = duckdb.sql("SELECT (i * 7919) % 100000 AS event_id, make_timestamp(1704067200000000 + i * 1000) AS ts, 4 AS user_id, 'view' AS event_type, 0.5 AS value, '{\"k\": ' || i % 1000 || '}' AS props FROM range(100000) t(i)")
    ids.write_parquet(f"{path}/events.parquet")
    stop = Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = QUERIES[name](spark, str(path)).orderBy("offset").collect()
    finally:
        stop.cancel()
    digest, length, want = hashlib.md5(seed.encode()), len(seed), []
    for n, i in enumerate(duckdb.sql("SELECT i FROM range(100000) t(i) ORDER BY (i * 7919) % 100000").fetchall()):
        digest.update(x := piece(i[0]).encode())
        length += len(x)
        want.append((0, n, "4", length, digest.hexdigest()))
    assert [tuple(r) for r in got] == want


def odd_events(path, ts):
    """Events without number or user, before and after others."""
    rows = [(1, 4, None), (2, 4, '{"k": 5}'), (3, 4, "{}"), (4, 8, '{"k": -6}'), (5, None, '{"k": 7}'), (6, -3, "no JSON"), (7, -3, None), (8, None, None), (9, -3, '{"k": 0}'), (10, 2, '{"x": 1}')]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', 0.5, ?)", [(i, ts, u, p) for i, u, p in rows])
    c.sql(f"COPY events TO '{path}/events.parquet'")
    c.execute("UPDATE events SET props = NULL WHERE props = 'no JSON'")  # DuckDB raises an error there
    return c


def test_concat_over_long_log(spark, tmp_path):
    told_over_long_log(spark, tmp_path, "agg_concat", "A", lambda i: str(i % 1000))


def test_concat_of_odd_events(spark, tmp_path):
    c = odd_events(tmp_path, "2024-01-01 00:00:00.25")
    same(QUERIES["agg_concat"](spark, str(tmp_path)), c.sql(SQL["agg_concat"]))


def test_concat_with_timestamp_over_long_log(spark, tmp_path):
    told_over_long_log(spark, tmp_path, "agg_concat_timestamp", "", lambda i: f"{i % 1000}_[2024-01-01 00:{i // 60000:02}:{i // 1000 % 60:02}{f'.{i % 1000:03}' if i % 1000 else ''} UTC]")


@pytest.mark.parametrize("ts", ["2024-01-01 00:00:00.25", "1969-12-31 23:59:59", "2300-07-01 12:00:00.007"])
def test_concat_with_timestamp_of_odd_events(spark, tmp_path, ts):
    c = odd_events(tmp_path, ts)
    same(QUERIES["agg_concat_timestamp"](spark, str(tmp_path)), c.sql(SQL["agg_concat_timestamp"]))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
