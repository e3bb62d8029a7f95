"""Frame statistics against plain loops, and on one crowded key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import S, frame, series
from meterloom.operators import calibrate as C
from meterloom.operators import profiles as PR
from meterloom.operators.frames import frame_stats, range_max, range_quantile


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_ranges_equal_slices(n):
    r = np.random.default_rng(n)
    v = r.integers(-5, 6, n) / 4
    a, z = np.sort(r.integers(0, n + 1, (2, 300)), axis=0)
    exp = lambda f: np.array([f(v[i:j]) if j > i else np.nan for i, j in zip(a, z)])
    assert np.array_equal(range_max(v, a, z), exp(np.max), equal_nan=True)
    for p in (0.0, 0.3, 0.5, 1.0):
        assert np.allclose(range_quantile(v, a, z, p), exp(lambda x: np.quantile(x, p)), equal_nan=True)


@pytest.mark.parametrize("width", [1 * S, 7 * S, 10_000 * S])
def test_frames_equal_a_loop(spark, width):
    rows, marks = series(21, keys=3, n=90, dup=0.3, none=0.2), series(22, keys=4, n=40, dup=0.3)
    frames = {"med": ("median", "w", -9 * S, -2 * S), "top": ("max", "w", 1 - 4 * S, 4 * S + 1), "n": ("count", "w", 2 * S, 9 * S)}
    got = frame_stats(frame(spark, marks + [(None, 5 * S, 0, 1.0)]), frame(spark, rows + [(None, 5 * S, 0, 1.0)]), ["k"], "ts_us", frames, chunk_us=width).collect()
    assert {(r.k, r.ts_us) for r in got} == {m[:2] for m in marks} and len(got) == len({m[:2] for m in marks})
    for r in got:
        v = {o: [x[3] for x in rows if x[0] == r.k and x[3] is not None and lo <= x[1] - r.ts_us < hi] for o, (_, _, lo, hi) in frames.items()}
        assert r.n == len(v["n"]) and r.top == (max(v["top"]) if v["top"] else None)
        assert r.med == (pytest.approx(np.median(v["med"])) if v["med"] else None)


def test_one_crowded_key_stays_linear(spark):
    n = 60_000  # each frame holds half of them: 1.8 billion pairs
    d = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 1000).alias("ts_us"), (F.col("id") % 1000).cast("double").alias("w"),
                              (F.col("id") % 7).cast("double").alias("st"), F.lit(0.001).alias("dt_s"))
    a = d.select("k", F.col("ts_us").alias("anchor_us"), F.col("ts_us").alias("press_us"))
    got = PR.spike_and_settle(a.drop("press_us"), d, ["k"], spike_s=15, near_s=1, far_s=30, max_dt_s=1).agg(F.count("spike"), F.max("spike"), F.count("settle")).first()
    assert got[:2] == (n, 6.0) and got[2] == n - 2 * 1001
    lv = C.pre_press_level(a.drop("anchor_us"), d.select("k", "ts_us", "w"), ["k"], span_s=30, gap_s=0).agg(F.count("level_w"), F.count_if(F.col("level_w") > 0)).first()
    assert tuple(lv) == (n, n - 3)
