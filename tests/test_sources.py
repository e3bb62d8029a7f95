"""Readers, sinks, discovery, labels, waveforms and streaming on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import H, S
from meterloom.functions import labels as L
from meterloom.functions import scalars as SC
from meterloom.operators import resample as RS
from meterloom.operators import sampling as SA
from meterloom.operators import stats as ST
from meterloom.operators import waveform as V
from meterloom.session import scratch_path
from meterloom.sources import audit as AU
from meterloom.sources import readings as RD
from meterloom.sources import store
from meterloom.sources import text as TX
from meterloom.streaming import online as ON


def test_dat_and_strict(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1.5 10 20\n2.25 11 21.5\n")
    got = TX.read_dat(spark, str(tmp_path / "a.dat")).orderBy("ts_us").collect()
    assert [(r.ts_us, r.v0, r.v1) for r in got] == [(1500000, 10.0, 20.0), (2250000, 11.0, 21.5)]
    (tmp_path / "b.dat").write_text("1 10\n2 oops\n")
    with pytest.raises(Exception, match="non-numeric"):
        TX.read_dat(spark, str(tmp_path / "b.dat")).count()


def test_dat_widths_differ_by_file(spark, tmp_path):
    (tmp_path / "one.dat").write_text("1 10\n2 11\n")
    (tmp_path / "two.dat").write_text("1 20 21\n2 22 23\n")
    got = sorted(map(tuple, TX.read_dat(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(S, 10.0, None), (2 * S, 11.0, None), (S, 20.0, 21.0), (2 * S, 22.0, 23.0)], key=str)
    (tmp_path / "one.dat").write_text("1 10\n2 11 12\n")
    with pytest.raises(Exception, match="non-numeric"):
        TX.read_dat(spark, str(tmp_path)).count()


def test_unix_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Unix,Aggregate\n2013-07-01 00:00:10,1372636810,5\n2013-07-01 00:00:20,1372636820,\n")
    got = TX.read_unix_csv(spark, str(tmp_path / "a.csv"), "Europe/London").orderBy("ts_us").collect()
    assert [(r.ts_us, r.ts_local_us - r.ts_us, r.Aggregate) for r in got] == [(1372636810 * S, 3600 * S, 5.0), (1372636820 * S, 3600 * S, None)]
    for odd in ("2013-07-01 02:00:10", "soon", ""):
        (tmp_path / "b.csv").write_text(f"Time,Unix,Aggregate\n{odd},1372636810,5\n")
        with pytest.raises(Exception, match="non-numeric"):
            TX.read_unix_csv(spark, str(tmp_path / "b.csv")).count()
    assert TX.resolve_column(["A", "UNIX_TS"]) == "UNIX_TS" and TX.resolve_column(["TIME", "Unix", "unix"]) == "unix"


def test_time_and_typing(spark):
    d = spark.createDataFrame([("1400000000", "2014-05-13 00:00:00", "x", "1"), ("1400000060", "2014-05-13 00:01:00", "y", "n/a")], "a string, b string, c string, d string")
    dec = {r["column"]: r.decision for r in TX.time_decision(d, ["a", "b", "c"]).collect()}
    assert dec == {"a": "seconds", "b": "datetime", "c": "none"}
    assert TX.apply_time(d, "a", "seconds").first().ts_us == 1400000000 * S
    pol = {r["column"]: r.numeric for r in TX.typing_policy(d, ["a", "d"]).collect()}
    assert pol == {"a": True, "d": False}
    assert dict(TX.apply_typing(d, pol).dtypes) == {"a": "double", "b": "string", "c": "string", "d": "string"}


def test_median_at_the_limit_of_unix_seconds(spark):
    cases = {"odd_above": [5, 2e8, 3e8], "odd_under": [5, 6, 3e8], "even_above": [5, 2e8], "even_under": [5, 1.5e8], "same": [1e8, 1e8], "negative": [-3e8, -2e8, 7], "one": [2e8], "nan": ["nan", 2e8]}
    for name, v in cases.items():
        d = spark.createDataFrame([(str(x),) for x in v], "c string")
        want = "seconds" if np.nanmedian(np.abs(np.array(v, float))) > 1e8 else "none"
        got = TX.time_decision(d, ["c"])
        assert got.first().decision == want, name
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # a column of near-unique stamps is never ranked


def test_day_files_and_local_midnight(spark, tmp_path):
    (tmp_path / "2012-07-01.csv").write_text("1,2\n3,4\n5\n")
    got = TX.read_day_files(spark, str(tmp_path / "*.csv"), 2, "Europe/Zurich").orderBy("ts_us").collect()
    t0 = 1341093600 * S  # 2012-06-30 22:00 UTC
    assert [(r.ts_us, r.powerallphases, r.col_1) for r in got] == [(t0, 1.0, 2.0), (t0 + S, 3.0, 4.0), (t0 + 2 * S, 5.0, None)]


def test_blocks(spark):
    lines = ["timestamp,aa,bb", "1,5,6", "2,NULL", "x,7,8", "timestamp,cc", "3,9", "3", "timestamp"]
    d = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "f string, n bigint, value string")
    got = sorted(((r.line, r.ts_us, r.meter, r.w) for r in TX.parse_blocks(d, ["f"], "n", lines_per_chunk=2).collect()), key=str)
    exp = [(1, S, "aa", 5.0), (1, S, "bb", 6.0), (2, 2 * S, "aa", None), (2, 2 * S, "bb", None), (3, None, "aa", 7.0), (3, None, "bb", 8.0), (5, 3 * S, "cc", 9.0), (6, 3 * S, "cc", None)]
    assert got == sorted(exp, key=str)
    a = TX.block_audit(d, ["f"]).first()
    assert (a.n_headers, a.n_degenerate, a.n_bad_ts, a.n_null_cells) == (3, 1, 1, 1)


def test_discovery_fixtures(spark):
    f = TX.discover(["datetime", "load_W", "oven_power_W", "oven_on", "pump_VA"])
    assert (f["ts"], f["power"], list(f["appliances"])) == ("datetime", "load_W", ["oven"])
    bad = spark.createDataFrame([("2023-03-05 07:30:00", "2.5", "0", "41"), ("2023-03-05 07:31:00", "2.25", "1", "40")], "stamp string, mains_power_kw string, pump_on string, oven_W string")
    codes = {r.code for r in TX.schema_check(bad).collect()}
    assert codes == {"time column guessed", "power column guessed", "flag without a power column", "power-like column ignored", "median power looks like kW"}
    ok = spark.createDataFrame([("2023-03-05 07:30:00", "240", "35", "1"), ("2023-03-05 07:31:00", "910", "700", "1")], "datetime string, load_W string, pump_power_W string, pump_on string")
    assert TX.schema_check(ok).count() == 0
    assert {(r.meter, r.w) for r in TX.appliance_readings(ok).collect()} == {("mains", 240.0), ("mains", 910.0), ("pump", 35.0), ("pump", 700.0)}


def test_metrics_fixture(spark):
    """Four days of half-hourly rows with a pump on two hours a day: duty 1/12."""
    rows = [(0, i * H // 2, i, 950.0 if i % 48 in (10, 11, 12, 13) else 1.0) for i in range(192)]
    d = spark.createDataFrame(rows, "k bigint, ts_us bigint, seq bigint, w double")
    assert ST.cadence(d, ["k"]).first().dt_med_s == 1800.0
    b = ST.channel_battery(d, ["k"]).first()
    assert (b.n, b.on_share, b.episodes, b.dwell_p50_s) == (192, 16 / 192, 4, 4 * 1800.0)
    assert RS.bucket_resample(d, ["k"], 86400).count() == 4


def test_store(spark):
    root = scratch_path(spark, "t")
    d = spark.createDataFrame([("x", "m", 3, 1.0), ("x", "m", 1, 2.0), ("y", "n", 2, None)], "building string, meter string, ts_us bigint, w double")
    store.write_series(d, root + "/s", ["building"])
    back = RD.read_series(spark, root + "/s", keys=["building"], t0_us=2)
    assert sorted((r.building, r.ts_us) for r in back.collect()) == [("x", 3), ("y", 2)]
    p = {r.building: r for r in store.series_profile(spark.read.parquet(root + "/s"), ["building"]).collect()}
    assert (p["x"]["rows"], p["x"].ts_min_us, p["y"].w_nulls) == (2, 1, 1)
    store.write_table_csv(spark.createDataFrame([("kettle", 1, 2, "manual_a", "h1")], store.MANUAL), root + "/manual")
    m = store.read_marks(spark, root + "/manual", root + "/missing").collect()
    assert [(r.device, r.provenance) for r in m] == [("kettle", "manual")]
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert sorted(map(tuple, store.merge_records(old, spark.createDataFrame([("b", 9.0)], old.schema), ["k"]).collect())) == [("a", 1.0), ("b", 9.0)]
    assert store.md_table(old.orderBy("k")).splitlines()[2] == "| a | 1.0 |"
    with pytest.raises(ValueError):
        store.md_table(spark.range(9), 3)


def test_labels(spark):
    lab = [("Washing_Machine", "washing_machine", "washing_machine"), ("washer  dryer", "washing_machine", "washer_dryer"), ("Fridge-Freezer", "fridge", "fridge_freezer"), ("TV", None, "tv"), ("", None, "unlabeled"),
           ("dish washer", "dishwasher", "dish_washer"), (None, None, "unlabeled")]
    d = spark.createDataFrame([(x,) for x, _, _ in lab], "l string").select("l", L.canonical_label(F.col("l")).alias("c"), L.slug(F.col("l")).alias("s"), L.class_prior(L.slug(F.col("l"))).alias("p"))
    assert [(r.l, r.c, r.s) for r in d.collect()] == lab
    e = spark.createDataFrame([(0, 1, "Fridge", "fridge"), (0, 2, "Freezer", "fridge"), (0, 3, "TV", None), (0, 4, "tv", None), (0, 5, "kettle!", None), (0, 6, "Kettle", "kettle"), (1, 1, "TV", None)], "b bigint, meter bigint, label string, canonical string")
    n = L.building_names(e, ["b"], "meter")
    assert {(r.b, r.meter): r.name for r in n.collect()} == {(0, 1): "fridge", (0, 2): "fridge_2", (0, 3): "tv", (0, 4): "tv_2", (0, 5): "kettle_2", (0, 6): "kettle", (1, 1): "tv"}
    assert L.name_clashes(n, ["b"]).count() == 0


def test_clocks(spark):
    d = spark.createDataFrame([(1396141200 * S,), (1396137600 * S,)], "t bigint")  # 2014-03-30 01:00 and 00:00 UTC
    off = {r.t: r.o for r in d.select("t", ((SC.local_us("t", "Europe/London") - F.col("t")) / S).alias("o")).collect()}
    assert off == {1396141200 * S: 3600, 1396137600 * S: 0}
    u = spark.createDataFrame([(1.4e9,), (1.4e12,), (1.4e15,), (1.4e18,)], "v double").select(SC.epoch_unit_us(F.col("v")).alias("u"))
    assert {r.u for r in u.collect()} == {1400000000000000}
    nan = spark.createDataFrame([(float("nan"),), (-1.0,), (0.0,)], "w double").select(RD.normalise_watts(F.col("w"), (-1.0,)).alias("w"))
    assert [r.w for r in nan.collect()] == [None, None, 0.0]


def test_audits(spark):
    d = spark.createDataFrame([("1", ""), ("x", None), ("x", "2"), ("y", "3")], "a string, b string")
    got = {r.col: r for r in AU.column_audit(d, ["a", "b"]).collect()}
    assert (got["a"].junk, got["a"].samples, got["b"].missing) == (3, ["x", "y"], 2)
    o = spark.createDataFrame([(0, i, t, None) for i, t in enumerate([5, 5, 4, 9])], "k bigint, i bigint, ts bigint, v string")
    r = AU.order_audit(o, ["k"], "i", "ts", ["v"], rows_per_chunk=2).first()
    assert (r.n_dup, r.n_decreasing, r.all_null) == (1, 1, "v")


def test_waveform(spark):
    n, size = 12, 500
    t = np.arange(n * size)
    v = 300 * np.sin(2 * np.pi * (t + 70) / size)
    i = 4 * np.sin(2 * np.pi * (t + 70) / size) + 1.0 * np.sin(2 * np.pi * 3 * (t + 70) / size)
    cap = spark.createDataFrame([(1, int(k), float(a), float(b)) for k, a, b in zip(t, v, i)], "capture bigint, idx bigint, v double, i double")
    c = V.cycles(cap)
    assert c.count() == n and abs(c.first().power_w - 600) < 1e-6
    ch = V.pick_cycles(c.withColumn("status", F.lit("off-on")), most=4, cycles_per_chunk=3)
    assert sorted(r.cycle for r in ch.collect()) == [6, 7, 9, 11]
    a = V.sync_average(cap, ch)
    assert a.count() == size
    h = V.harmonics(a, 5)
    db = {r.h: r.db for r in h.collect()}
    assert abs(db[1]) < 1e-9 and abs(db[3] - 20 * math.log10(0.25)) < 1e-6
    assert abs(V.distortion(h).first().thd_pct - 25) < 1e-6


def test_sampling(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(30)] + [("b", 100 + i, 5.0) for i in range(3)], "l string, id bigint, x double")
    s1, s2 = SA.subsample(d, "l", "id", 5, 1), SA.subsample(d.repartition(7), "l", "id", 5, 1)
    ids = sorted(r.id for r in s1.collect())
    assert len(ids) == 8 and ids == sorted(r.id for r in s2.collect())
    b = {(r.l, r.n): r for r in SA.bootstrap_medians(d, ["l"], "id", ["x"], (2, 10), 50, 3).collect()}
    assert b["b", 10].x_p50 == 5.0 and b["a", 10].x_p5 <= b["a", 10].x_p50 <= b["a", 10].x_p95
    assert b["a", 2].x_p95 - b["a", 2].x_p5 > b["a", 10].x_p95 - b["a", 10].x_p5


# ---------------------------------------------------------------- streaming over several files

SCHEMA = "k bigint, ts timestamp, ts_us bigint, w double"


def stream_of(spark, triggers):
    """One file per trigger, in order; the last one moves the watermark past all rows."""
    path = scratch_path(spark, "in")
    for i, rows in enumerate([*triggers, [(None, 10 ** 7, -1)]]):
        df = spark.createDataFrame([(k, t * S, float(w)) for k, t, w in rows], "k bigint, ts_us bigint, w double").select("k", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "w")
        df.coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)  # the file source orders by modification time
    return ON.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_stream_state_crosses_triggers(spark):
    trig = [[(0, 0, 0), (0, 10, 100), (1, 1, 100)], [(0, 20, 30), (0, 30, 0), (1, 400, 100)], [(0, 5000, 100), (1, 5000, 0)], [(0, 20000, 0), (1, 20000, 0)]]
    h = ON.run_to_table(ON.hysteresis(stream_of(spark, trig), ["k"], 50.0, 25.0, late="10 seconds"), "h").collect()
    # 30 W keeps the episode open; it ends at its last reading above the low level
    assert sorted((r.k, r.t_on_us // S, r.t_off_us // S, r.n_rows) for r in h) == [(0, 10, 20, 2), (0, 5000, 5000, 1), (1, 1, 400, 2)]
    e = ON.run_to_table(ON.running_energy(stream_of(spark, trig), ["k"], 60.0, late="10 seconds"), "e").groupBy("k").agg(F.max("energy_wh").alias("e")).collect()
    assert {r.k: round(r.e * 3600, 6) for r in e} == {0: 100 * 10 + 30 * 10 + 100 * 60, 1: 100 * 60 + 100 * 60}
    g = ON.run_to_table(ON.gap_watchdog(stream_of(spark, trig), ["k"], 1000.0, late="10 seconds"), "g").collect()
    seen = {(r.k, r.last_us // S) for r in g}
    assert {(0, 30), (1, 400), (0, 5000), (1, 5000)} <= seen
    assert {(r.k, r.last_us // S) for r in g if r.next_us == -1} >= {(0, 20000), (1, 20000)}


def test_stream_timer_and_gate(spark):
    trig = [[(0, 100, 100), (0, 110, 100)], [(1, 5000, 1)], [(1, 9000, 1)]]
    h = ON.run_to_table(ON.hysteresis(stream_of(spark, trig), ["k"], 50.0, 25.0, idle_s=60.0, late="10 seconds"), "t").collect()
    assert [(r.k, r.t_on_us, r.t_off_us // S, r.timed_out) for r in h] == [(0, 100 * S, 110, True)]
    dup = [[(0, 100, 5), (0, 100, 5), (0, 101, 99999), (0, 102, -3), (0, 103, 7)]]
    g = ON.run_to_table(ON.ingest_gate(stream_of(spark, dup), ["k"]), "d").collect()
    assert sorted(r.w for r in g) == [5.0, 7.0]


def test_footers_answer_without_reading_columns(spark, tmp_path):
    from meterloom.sources import store as STO

    path = str(tmp_path / "t.parquet")
    spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 2).alias("v"), F.lit("x").alias("s")).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    row = STO.footer_profile(spark, path, ["id", "v"], ["s"]).first().asDict()
    assert row == {"rows": 1000, "min_id": 0, "max_id": 999, "min_v": 2, "max_v": 1998, "nulls_id": 0, "nulls_v": 143, "nulls_s": 0}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    spark.conf.set("spark.sql.sources.useV1SourceList", STO.FOOTERS["spark.sql.sources.useV1SourceList"])
    try:
        plan = STO.footer_plan(spark, path, ["id", "v"], ["s"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
    assert "PushedAggregation: [COUNT(*), MIN(id)" in plan


def test_block_columns_and_ragged_lines(spark):
    lines = ["1,2", "timestamp,a,b", "1,2,3", "2,,x", "3,NULL,4,9", "timestamp,c", "4,5,6", "", "5"]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(lines)], "k int, line bigint, value string").repartition(3)
    for width in (1, 3, 1000):
        assert [tuple(r) for r in TX.ragged_lines(df, ["k"], "line", lines_per_chunk=width).collect()] == [(0, 6, 2)]
        got = {r["col"]: (r.n, r.nulls, r.junk) for r in TX.block_columns(df, ["k"], "line", lines_per_chunk=width).collect()}
        assert got == {"a": (3, 2, 0), "b": (3, 0, 1), "c": (1, 0, 0), "<ragged>": (2, 0, 0)}
