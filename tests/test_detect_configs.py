"""Detectors walked in chunks against a plain loop; truth rows against all pairs."""

import pytest

from helpers import S, by_key, frame, series
from meterloom.operators import sweeps as SW
from meterloom.plans.catalog import Tables
from meterloom.plans.series_plans import channel_episodes
from meterloom.plans import sweep_plans as P

SMALL = "/root/testdata/sf0.001"
CONFIGS = [c for c in SW.EXPERIMENTS if c[0] in ("E00", "E01", "E05", "E12")]


@pytest.mark.parametrize("rows_per_chunk", [3, 17, 1000])
def test_detections_equal_the_row_loop(spark, rows_per_chunk):
    rows = series(31, keys=3, n=120, none=0.2)
    sig = [(k, d, p, p, p, p, 0.0, 0.0) for k in range(3) for d, p in (("a", 60.0), ("b", 25.0))]
    sig = spark.createDataFrame(sig, "k bigint, device string, on_w double, on_p10_w double, on_p25_w double, on_p90_w double, dwell_p10_s double, dwell_p90_s double")
    floor = spark.createDataFrame([(k, 1.0) for k in range(3)], "k bigint, floor_w double")
    plan = SW.detect_configs(frame(spark, rows), sig, floor, CONFIGS, ["k"], dt_s=6.0, chunk_us=40 * S, rows_per_chunk=rows_per_chunk)
    exp = []
    for k, rs in by_key(rows).items():
        for dev, p in (("a", 60.0), ("b", 25.0)):
            for e, _, enter, leave, least, merge, *_ in CONFIGS:
                on, state, runs = [], 0, []
                for r in rs:
                    x = None if r[3] is None else r[3] - 1.0
                    state = state if x is None else 1 if x >= enter * p else 0 if x <= leave * p else state
                    on.append(state)
                for i, s in enumerate(on):
                    if s and (i == 0 or not on[i - 1]):
                        runs.append([i, next((j for j in range(i, len(on)) if not on[j]), len(on))])
                out = []
                for a, z in (r for r in runs if r[1] - r[0] >= least):
                    if out and a - out[-1][1] <= merge:
                        out[-1][1] = z
                    else:
                        out.append([a, z])
                exp += [(k, dev, e, a, z - a) for a, z in out]
    assert sorted((r.k, r.device, r.exp, r.i_on, r.n_samples) for r in plan.collect()) == sorted(exp)


def test_truth_rows_equal_all_pairs(spark):
    t = Tables(spark, SMALL)
    mains = {}
    for r in sorted(t.mains.collect(), key=lambda r: (r.house, r.ts_us, r.seq)):
        mains.setdefault(r.house, []).append(r.ts_us)
    exp = []
    for e in channel_episodes(t).collect():
        at = [i for i, x in enumerate(mains[e.house]) if e.t_on_us <= x <= e.t_off_us]
        exp.append((e.house, e.device, at[0], at[-1] - at[0] + 1))
    plan = P.truth_rows(t, ["E00"])
    assert sorted((r.house, r.device, r.start, r.length) for r in plan.collect()) == sorted(exp)
