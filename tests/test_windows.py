"""Contaminated, quiet and pressed windows against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from helpers import S
from meterloom.operators import windows as W

H = 3600 * S


def episodes_of(spark, seed=4, n=40):
    r = random.Random(seed)
    rows = []
    for k in (0, 1):
        for dev in "abc":
            t = r.randint(0, 4000)
            for _ in range(n if (k, dev) == (0, "a") else n // 4):
                t += r.randint(1, 9000)
                end = t + r.randint(0, 4000)
                rows.append((k, dev, t * S, end * S))
                t = end
    return rows, spark.createDataFrame(rows, "house bigint, device string, t_on_us bigint, t_off_us bigint").repartition(3)


def test_contamination_equals_all_pairs(spark):
    rows, ep = episodes_of(spark)
    for pad, edge, chunk in ((0, 100, 7 * H), (500, 30, 100 * S)):
        got = {(r.house, r.device, r.t_on_us): (r.n_inside, r.n_start, r.n_end, r.raw, r.harmful) for r in W.contamination(ep, ["house"], pad_s=pad, edge_s=edge, chunk_us=chunk).collect()}
        for k, d, a, z in rows:
            ev = [t for kk, dd, b, y in rows if kk == k and dd != d for t in (b, y)]
            near = lambda lo, hi: sum(lo <= t <= hi for t in ev)
            n = (near(a - pad * S, z + pad * S), near(a - edge * S, a + edge * S), near(z - edge * S, z + edge * S))
            assert got[k, d, a] == (*n, n[0] > 0, n[1] + n[2] > 0)


def test_quiet_share_equals_a_walk_by_seconds(spark):
    rows, ep = episodes_of(spark, 9, 12)
    got = {(r.house, r.hour, r.length_s): r.share for r in W.quiet_share(ep, ["house"], [60.0, 1800.0], chunk_us=5 * H).collect()}
    for k in (0, 1):
        own = [(a // S, z // S) for kk, _, a, z in rows if kk == k]
        lo, hi = min(a for a, _ in own), max(z for _, z in own)
        busy = np.zeros(hi - lo + 1, bool)
        for a, z in own:
            busy[a - lo:z - lo] = True
            busy[a - lo] |= a == z  # a moment
        for length in (60, 1800):
            free = {}
            seen = {}
            for s in range(lo, hi):
                hour = s // 3600 % 24
                seen[hour] = seen.get(hour, 0) + 1
                free[hour] = free.get(hour, 0) + (s + length <= hi and not busy[s - lo:s - lo + length].any())
            for hour, n in seen.items():
                assert abs(got[k, hour, float(length)] - free[hour] / n) < 12 / n  # ends of stretches may lie a second apart


def test_presses_snap_to_the_largest_rise(spark):
    w = [5.0] * 10 + [100.0] * 10 + [5.0] * 10 + [40.0] * 10
    readings = spark.createDataFrame([(0, i * 10 * S, i, x) for i, x in enumerate(w)], "k bigint, ts_us bigint, seq bigint, w double").repartition(3)
    marks = spark.createDataFrame([(0, i, t * S, 200 * S) for i, t in enumerate([100, 85, 118, 60, 290, 20])], "k bigint, i bigint, p bigint, off bigint")
    for bucket in (30 * S, 10_000 * S):
        got = {r.i: r.q // S for r in W.snap_to_step(marks, readings, ["k"], ["i"], at="p", within_s=25, rows=3, bucket_us=bucket, out="q").collect()}
        assert got == {0: 100, 1: 100, 2: 100, 3: 80, 4: 300, 5: 20}  # nothing near the last one, a part of the rise near the fourth
        lv = {r.i: r.level_w for r in W.level_between(marks, readings, ["k"], ["i"], start="p", end="off", base_s=30, bucket_us=bucket).collect()}
        assert lv[0] == 95.0 and abs(lv[2] - (100 - 205 / 3)) < 1e-9 and lv[4] is None
        assert abs(lv[1] - (sum(w[9:20]) / 11 - 5)) < 1e-9
    fall = W.snap_to_step(marks.where("i = 0").withColumn("p", F.lit(190 * S)), readings, ["k"], ["i"], at="p", within_s=25, rows=3, rising=False, out="q").first()
    assert fall.q == 200 * S
