"""Events that share a stamp: the queries and their SQL follow one rule."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from meterloom.plans import load_catalog

S = 1_000_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two users of one house report at the same microsecond, with equal and with different values; some stamps are 1 us apart."""
    t0, out = dt.datetime(2024, 1, 1), []
    for i in range(240):
        at = t0 + dt.timedelta(seconds=40 * (i // 4), microseconds=(i // 2) % 2)
        out.append((i, at, 5 * (i % 2) + i // 80, "view" if i % 8 < 4 else "click", float(i // 2 % 7 if i % 3 else i % 230), "{}"))
    path = str(tmp_path_factory.mktemp("stamps"))
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", out)
    con.execute(f"COPY e TO '{path}/events.parquet' (FORMAT parquet)")
    return path


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    return sorted(tuple(r[c] for c in cols) for r in entry.queries()[name](spark, folder).collect()), sorted(cur.fetchall())


@pytest.mark.parametrize("name", ["j05_cross_check", "r05_stream_gate", "w08_activation_runs", "j21_spike_and_settle"])
def test_equal_stamps_equal_the_sql(spark, folder, name):
    assert name in load_catalog()
    got, exp = both(spark, folder, name)
    assert got == exp


def test_a_press_told_twice_is_one(spark, folder):
    """The SQL counts a reading once for each such press, so levels of one or two readings are compared by their keys only."""
    got, exp = both(spark, folder, "m11_pre_press_level")
    assert [r[:3] for r in got] == [r[:3] for r in exp] and all(g[3] in (0.0, e[3]) for g, e in zip(got, exp))
