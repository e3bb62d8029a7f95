"""Rules in stamp order against plain row loops, late rows, their side table and their repair."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom.session import scratch_path
from meterloom.streaming import late as L
from meterloom.streaming import online as ON
from meterloom.streaming.inorder import Gaps, HoldEnergy, Hysteresis

S = 1_000_000
SCHEMA = "k bigint, ts timestamp, ts_us bigint, w double, seq bigint, arrival bigint"


def cut(rows, width):
    """Slots of a list of (t, w) in stamp order."""
    slots = {}
    for t, w in rows:
        slots.setdefault(t // width, []).append((t, w))
    return [(np.array([t for t, _ in s]), np.array([w for _, w in s], float)) for _, s in sorted(slots.items())]


def folded(rule, rows, width, flush):
    carry, out = rule.first, []
    for t, w in cut(rows, width):
        carry, cols = rule.fold(carry, t, w)
        out += list(zip(*[np.asarray(c).tolist() for c in cols.values()]))
    if flush and rule.wakes_at(carry) is not None:
        out += list(zip(*[c.tolist() for c in rule.silent(carry)[1].values()]))
    return out


def plain_hysteresis(rows, hi, lo, idle):
    on, start, last, n, seen, out = False, 0, 0, 0, None, []
    for t, w in rows:
        if on and idle is not None and t - seen > idle:
            out.append((start, last, n, True))
            on = False
        elif idle is not None and seen is not None and t - seen > idle:
            on = False
        seen = t
        now = True if w >= hi else False if w <= lo else on
        if now and not on:
            start, n = t, 0
        if now:
            last, n = t, n + 1
        elif on:
            out.append((start, last, n, False))
        on = now
    if on and idle is not None:
        out.append((start, last, n, True))
    return out


STEPS = st.lists(st.tuples(st.integers(0, 40), st.sampled_from([0.0, 10.0, 25.0, 30.0, 50.0, 80.0, float("nan")])), min_size=1, max_size=40)


@settings(max_examples=400, deadline=None)
@given(STEPS, st.sampled_from([3, 17, 100, 5000]), st.sampled_from([None, 5, 30]))
def test_hysteresis_slots_equal_the_row_loop(steps, width, idle):
    t, rows = 7, []
    for d, w in steps:
        t += d
        rows.append((t, w))
    assert folded(Hysteresis(50.0, 25.0, idle), rows, width, True) == plain_hysteresis(rows, 50.0, 25.0, idle)


@settings(max_examples=200, deadline=None)
@given(STEPS, st.sampled_from([3, 17, 100]))
def test_gaps_and_energy_slots_equal_the_row_loop(steps, width):
    t, rows = 7, []
    for d, w in steps:
        t += d
        rows.append((t, w))
    assert folded(Gaps(20), rows, width, False) == [(a, b) for (a, _), (b, _) in zip(rows, rows[1:]) if b - a > 20]
    total = sum((0 if w != w else w) * min(b - a, 25) for (a, w), (b, _) in zip(rows, rows[1:])) / 3.6e9
    last = folded(HoldEnergy(25), rows, width, False)[-1]
    assert last[0] == rows[-1][0] and abs(last[1] - total) < 1e-15


def late_rows(seed=3, n=240, most=600):
    """Three keys, one with most rows; delays of up to `most` seconds."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randint(0, 6000) * S
        rows.append((rnd.choice([0, 0, 0, 1, None if i % 40 == 0 else 2]), t, rnd.choice([0.0, 30.0, 90.0]), i, t + rnd.randint(0, most) * S))
    return rows


def frame(spark, rows):
    d = spark.createDataFrame(rows, "k bigint, ts_us bigint, w double, seq bigint, arrival bigint")
    return d.select("k", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "w", "seq", "arrival")


def test_order_of_arrival_changes_nothing(spark):
    rows = late_rows()
    rule = lambda s: ON.hysteresis(s, ["k"], 50.0, 25.0, idle_s=300, late="601 seconds", slot_s=200, order="seq")
    got = sorted((r.k, r.t_on_us, r.t_off_us, r.n_rows, r.timed_out) for r in L.replay(frame(spark, rows), "arrival", 5, rule, "order").collect())
    want = []
    for k in (0, 1, 2):
        own = [(t, w) for t, _, w in sorted((t, i, w) for kk, t, w, i, _ in rows if kk == k)]
        want += [(k, *e) for e in plain_hysteresis(own, 50.0, 25.0, 300 * S)]
    assert got == sorted(want)


def plain_sessions(rows, thr, gap):
    out = []
    for k in sorted({k for k, *_ in rows if k is not None}):
        for t in sorted(t for kk, t, w, *_ in rows if kk == k and w > thr):
            if out and out[-1][0] == k and t - out[-1][2] <= gap:
                out[-1] = (k, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((k, t, t, 1))
    return out


def test_late_rows_go_aside_and_are_repaired(spark):
    day = 86_400
    rnd = random.Random(8)
    rows = [(k, t * S, w, i, t * S + d * S) for i, (k, t, w, d) in enumerate(
        (rnd.choice([0, 0, 0, 1]), rnd.randint(0, 6 * day), rnd.choice([10.0, 90.0, 90.0]), rnd.choice([0, 0, day // 2, 3 * day])) for _ in range(500))]
    rows += [(None, 5 * S, 90.0, 900, 5 * S)]
    df = frame(spark, rows)
    folder, source, schema = scratch_path(spark, "late"), scratch_path(spark, "late-in"), df.drop("arrival").schema
    lo, hi = min(r[4] for r in rows), max(r[4] for r in rows)
    for _ in L.arrivals(df, "arrival", 5, source):
        L.split_late(ON.read_stream(spark, source, schema), folder, day / 4)
        L.online_sessions(folder, schema, lambda s: ON.on_sessions(s, ["k"], 60.0, "1800 seconds", late="21600 seconds"), spark)
    # the side table has what the earlier slices' newest stamp leaves behind
    high, aside = None, set()
    for part in range(5):
        now = [r for r in rows if (r[4] - lo) * 5 // (hi - lo + 1) == part]
        aside |= {r[3] for r in now if high is not None and r[1] <= high - day // 4 * S}
        high = max([r[1] for r in now] + ([high] if high is not None else []))
    assert {r.seq for r in spark.read.parquet(f"{folder}/late/*").collect()} == aside and len(aside) > 50
    L.publish(spark, folder, ["k"])
    taken = lambda: sorted((r.k, r.t_on_us, r.t_off_us, r.n_rows) for r in L.served(spark, folder).where("k IS NOT NULL").collect())
    assert taken() == plain_sessions([r for r in rows if r[3] not in aside], 60.0, 1800 * S)
    for _ in range(2):  # the second run changes nothing
        L.repair_sessions(spark, folder, ["k"], 60.0, 1800.0)
        assert taken() == plain_sessions(rows, 60.0, 1800 * S)
    # a batch that is run again decides as before
    before = spark.read.parquet(f"{folder}/late/*").count()
    L.split_late(ON.read_stream(spark, source, schema), folder, day / 4)
    assert spark.read.parquet(f"{folder}/late/*").count() == before


def test_no_late_rows_and_no_rows(spark):
    rows = [(0, t * S, 90.0, t, t * S) for t in (0, 10, 5000)]
    df = frame(spark, rows)
    folder, source, schema = scratch_path(spark, "intime"), scratch_path(spark, "intime-in"), df.drop("arrival").schema
    for _ in L.arrivals(df, "arrival", 2, source):
        L.split_late(ON.read_stream(spark, source, schema), folder, 60)
        L.online_sessions(folder, schema, lambda s: ON.on_sessions(s, ["k"], 60.0, "100 seconds", late="60 seconds"), spark)
    L.publish(spark, folder, ["k"])
    L.repair_sessions(spark, folder, ["k"], 60.0, 100.0)
    assert sorted((r.t_on_us, r.n_rows) for r in L.served(spark, folder).where("k = 0").collect()) == [(0, 2), (5000 * S, 1)]
    rule = lambda s: ON.gap_watchdog(s, ["k"], 10.0, late="60 seconds")
    assert L.replay(df.limit(0), "arrival", 2, rule, "none").count() == 0
