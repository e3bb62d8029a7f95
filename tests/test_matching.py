"""Matching, decoding and calibration against plain loops."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import S, first_fit, greedy, two_pointer
from meterloom.operators import calibrate as C
from meterloom.operators import decode as D
from meterloom.operators import matching as M
from meterloom.operators import stats as ST
from meterloom.operators import sweeps as SW


def spans(seed, n, spread=120):
    r = random.Random(seed)
    out = []
    for k in range(3):
        for t in sorted(r.sample(range(spread), r.randint(1, n))):
            out.append((k, t * S, (t + r.randint(1, 9)) * S))
    return out


def df(spark, rows):
    return spark.createDataFrame(rows, "k bigint, t_on_us bigint, t_off_us bigint")


def test_two_pointer_equals_first_fit():
    """Both definitions pick the same pairs on sorted onsets."""
    r = random.Random(1)
    for _ in range(4000):
        g = sorted(r.choices(range(30), k=r.randint(0, 8)))
        p = sorted(r.choices(range(30), k=r.randint(0, 8)))
        tau = r.randint(0, 6)
        assert two_pointer(g, p, tau) == first_fit(g, p, tau)


@pytest.mark.parametrize("chunk", [1, 10 * S, 1000 * S])
@pytest.mark.parametrize("seed,spread,tau", [(1, 120, 3), (2, 60, 4), (3, 40, 9)])
def test_match_onsets(spark, seed, spread, tau, chunk):
    """Dense onsets, which wait over several edges."""
    g, p = spans(seed, 25, spread), spans(seed + 50, 25, spread)
    exp = []
    for k in range(3):
        a, b = [x[1] for x in g if x[0] == k], [x[1] for x in p if x[0] == k]
        exp += [(k, a[i], b[j]) for i, j in two_pointer(a, b, tau * S)]
    got = M.match_onsets(df(spark, g), df(spark, p), ["k"], tau * S, chunk_us=chunk)
    assert sorted((r.k, r.g_on, r.p_on) for r in got.collect()) == sorted(exp)
    got = M.match_first_fit(df(spark, g), df(spark, p), ["k"], tau * S, chunk_us=chunk)
    assert sorted((r.k, r.g_on, r.p_on) for r in got.collect()) == sorted(exp)


def test_match_onsets_that_never_rest(spark):
    """Every onset lies within tau of the next, and each pairing shifts all later ones."""
    g = [(0, 2 * i * S, 2 * i * S + 1) for i in range(150)]
    p = [(0, (2 * i + 1) * S, (2 * i + 1) * S + 1) for i in range(1, 150) if i % 40]
    exp = two_pointer([x[1] for x in g], [x[1] for x in p], 5 * S)
    for chunk in (1, 30 * S):
        got = M.match_onsets(df(spark, g), df(spark, p), ["k"], 5 * S, chunk_us=chunk).collect()
        assert sorted((r.g_on, r.p_on) for r in got) == sorted((g[i][1], p[j][1]) for i, j in exp)
    assert M.match_onsets(df(spark, g), df(spark, []), ["k"], 5 * S).count() == 0
    assert M.match_first_fit(df(spark, []), df(spark, p), ["k"], 5 * S).count() == 0


def test_cheapest_assignment(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randint(0, 9)) for _ in range(n)], [float(r.randint(0, 9)) for _ in range(m)]) for i, (n, m) in enumerate([(5, 5)] * 12 + [(3, 5), (1, 1), (2, 4), (0, 2), (3, 2)])]
    got = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", M.cheapest_assignment(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y)).alias("z")).collect()
    for row in got:
        _, a, b = rows[row.i]
        if not a or len(a) > len(b):
            assert row.z is None
            continue
        assert (row.z.cost, row.z.chosen) == min((sum(abs(x - b[j]) for x, j in zip(a, c)), list(c)) for c in itertools.permutations(range(len(b)), len(a)))
    # ten devices: levels that are a shuffle of each other have one assignment without cost
    levels = [float(3 ** i) for i in range(10)]
    mixed = r.sample(levels, 10)
    z = spark.createDataFrame([(levels, mixed)], "a array<double>, b array<double>").select(M.cheapest_assignment(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y)).alias("z")).first().z
    assert z.cost == 0 and [mixed[j] for j in z.chosen] == levels


@pytest.mark.parametrize("seed", [3, 4])
def test_match_best_and_overlap(spark, seed):
    g, p = spans(seed, 20), spans(seed + 70, 20)
    num = lambda rows: [(k, i, a, (b - a) // S) for k in range(3) for i, (_, a, b) in enumerate([x for x in rows if x[0] == k])]
    gi, pi = num(g), num(p)
    mk = lambda rows: spark.createDataFrame(rows, "k bigint, id bigint, start bigint, length bigint")
    got = M.match_best(mk(gi), mk(pi), ["k"], tol=5 * S, bucket=9 * S)
    exp = []
    for k in range(3):
        c = [(abs(a[2] - b[2]), a[2], b[1], a[1]) for a in gi for b in pi if a[0] == b[0] == k and abs(a[2] - b[2]) <= 5 * S and 0.5 <= a[3] / max(b[3], 1) <= 2]
        exp += [(k, x, y) for x, y in greedy([(q[3], q[2]) for q in sorted(c)])]
    assert sorted((r.k, r.g_id, r.d_id) for r in got.collect()) == sorted(exp)
    ov = lambda rows: spark.createDataFrame([(k, i, a, a + n * S) for k, i, a, n in rows], "k bigint, id bigint, t0_us bigint, t1_us bigint")
    got = M.match_overlap(ov(gi), ov(pi), ["k"], min_s=2.0, min_frac=0.3, bucket_us=7 * S)
    exp = []
    for k in range(3):
        c = []
        for a in gi:
            for b in pi:
                o = min(a[2] + a[3] * S, b[2] + b[3] * S) - max(a[2], b[2])
                if a[0] == b[0] == k and o > 0 and o >= min(2 * S, 0.3 * a[3] * S):
                    c.append((o, a[1], b[1]))
        exp += [(k, x, y) for x, y in greedy([(q[1], q[2]) for q in sorted(c, reverse=True)])]
    assert sorted((r.k, r.g_id, r.c_id) for r in got.collect()) == sorted(exp)


def test_score_and_spans(spark):
    g = df(spark, [(0, 0, 10 * S), (0, 100 * S, 110 * S), (1, 0, 10 * S)])
    p = df(spark, [(0, 1 * S, 9 * S), (0, 101 * S, 160 * S), (2, 5, 6)])
    m = M.match_onsets(g, p, ["k"], 2 * S).where(M.in_dwell_band())
    s = {r.k: r for r in M.score(g, p, m, ["k"]).collect()}
    assert (s[0].n_gt, s[0].n_pred, s[0].n_matched, s[0].f1) == (2, 2, 1, 0.5)
    assert s[1].recall == 0 and s[2].precision == 0
    e = M.span_errors(m).first()
    assert (e.onset_err_s, e.offset_err_s, e.dur_ratio, e.iou) == (1.0, -1.0, 0.8, 0.8)


# ---------------------------------------------------------------- decoding

def brute(obs, mu, sd, stay, sigma, cadence):
    """Enumerate all joint paths of a short block."""
    n_dev = len(mu)
    states = list(itertools.product((0, 1), repeat=n_dev))
    off = 1 - 1 / max(D.OFF_DWELL_S / cadence, 1)
    lev = [sum(m * s for m, s in zip(mu, st)) for st in states]
    dev = [np.sqrt(sigma**2 + sum(max(d * d - sigma**2, 0) * s for d, s in zip(sd, st))) for st in states]
    em = [[-0.5 * ((o - a) / b) ** 2 - np.log(np.sqrt(2 * np.pi) * b) for a, b in zip(lev, dev)] for o in obs]

    def tr(a, b):
        p = 1.0
        for d in range(n_dev):
            q = off if a[d] == 0 else stay[d]
            p *= q if a[d] == b[d] else 1 - q
        return p

    init = []
    for st in states:
        p = 1.0
        for d, s in enumerate(st):
            r = (1 - off) / ((1 - off) + (1 - stay[d]))
            p *= r if s else 1 - r
        init.append(p)
    post, best, total = np.zeros((len(obs), n_dev)), (-1e99, None), 0.0
    for path in itertools.product(range(len(states)), repeat=len(obs)):
        lp = np.log(init[path[0]]) + sum(em[t][s] for t, s in enumerate(path)) + sum(np.log(tr(states[a], states[b])) for a, b in zip(path, path[1:]))
        w = np.exp(lp)
        total += w
        for t, s in enumerate(path):
            post[t] += w * np.array(states[s])
        if lp > best[0]:
            best = (lp, path)
    return [states[s] for s in best[1]], post / total, np.log(total)


def test_decode_block_against_enumeration():
    obs = np.array([2.0, 48.0, 55.0, 170.0, 120.0, 1.0])
    mu, sd, stay = [50.0, 110.0], [9.0, 14.0], [0.8, 0.7]
    on, marg, gated, ll = D.decode_block(obs, np.array([mu]), np.array([sd]), np.array([stay]), np.array([6.0]), 600.0)
    path, post, total = brute(obs, mu, sd, stay, 6.0, 600.0)
    assert [tuple(x) for x in on[:, 0]] == path
    assert np.allclose(marg[:, 0], post) and np.isclose(ll.sum(), total)
    assert not gated[3, 0]
    assert D.decode_block(np.array([0.0, 900.0]), np.array([mu]), np.array([sd]), np.array([stay]), np.array([6.0]), 600.0)[2][1, 0]


def test_decode_chunks(spark):
    """Known additive truth comes back, and chunking with warm-up changes nothing."""
    r = np.random.default_rng(3)
    a = (np.arange(400) // 25) % 2
    b = (np.arange(400) // 60) % 2
    w = 30 + 80 * a + 300 * b + r.normal(0, 4, 400)
    rows = [(h, int(i) * 6 * S, int(i), float(x + h)) for h in (0, 1) for i, x in enumerate(w)]
    d = spark.createDataFrame(rows, "h bigint, ts_us bigint, seq bigint, w double")
    par = spark.createDataFrame([(h, q, ["a", "b"], [80.0, 300.0], [5.0, 5.0], [0.96, 0.98], 5.0, 30.0) for h in (0, 1) for q in range(3)],
                                "h bigint, row_id bigint, devices array<string>, mu array<double>, sd array<double>, p_stay array<double>, sigma_off double, floor_w double")
    one = D.decode(d, par, ["h"], cadence_s=6.0, chunk_steps=1000, warm_steps=10).collect()
    cut = D.decode(d, par, ["h"], cadence_s=6.0, chunk_steps=64, warm_steps=40, slice_rows=2).collect()
    k = lambda rs: {(x.h, x.row_id, x.ts_us, x.device): (x.on, round(x.marg, 6), x.gated) for x in rs}
    assert len(one) == 2 * 3 * 400 * 2 and k(one) == k(cut)
    got = [x for x in sorted(one, key=lambda x: x.ts_us) if x.h == 0 and x.row_id == 0]
    assert [x.on for x in got if x.device == "a"] == a.tolist() and [x.on for x in got if x.device == "b"] == b.tolist()


def test_em_finds_levels(spark):
    r = np.random.default_rng(4)
    on = (np.arange(600) // 30) % 2
    rows = [(0, int(i) * 6 * S, int(i), float(20 + 150 * o + r.normal(0, 3))) for i, o in enumerate(on)]
    d = spark.createDataFrame(rows, "h bigint, ts_us bigint, seq bigint, w double")
    noise = spark.createDataFrame([(0, 20.0, 4.0)], "h bigint, floor_w double, sigma_off double")
    fit = D.em_fit(d, ["h"], ["x"], noise, cadence_s=6.0, iters=3, restarts=2, chunk_steps=256, warm_steps=30).first()
    assert abs(fit.mu[0] - 150) < 5 and fit.p_stay[0] > 0.9


# ---------------------------------------------------------------- calibration

def test_session_draws(spark):
    pool = spark.createDataFrame([(0, i * S, (i + 1) * S, i % 3 == 0) for i in range(12)] + [(1, i * S, (i + 1) * S, True) for i in range(4)],
                                 "g bigint, t_on_us bigint, t_off_us bigint, flagged boolean")
    d = C.draw_sessions(pool, ["g"], "flagged", (1, 5), 4, 7)
    got = d.collect()
    per = {}
    for r in got:
        assert r.g == 0 and not r.flagged
        per.setdefault((r.k, r["draw"]), []).append(r.slot)
    assert all(len(v) <= k and max(v) < max(4 * k, 8) + k for (k, _), v in per.items())
    assert all(len(per[5, i]) == 5 for i in range(4))
    again = C.draw_sessions(pool.repartition(7), ["g"], "flagged", (1, 5), 4, 7)
    assert sorted(map(str, got)) == sorted(map(str, again.select(*d.columns).collect()))


def test_classify_and_loo(spark):
    lib = spark.createDataFrame([(0, "kettle", 2000.0, 60.0, 120.0, 200.0), (0, "fridge", 90.0, 600.0, 900.0, 1200.0)],
                                "h bigint, device string, on_w double, dwell_p10_s double, dwell_p50_s double, dwell_p90_s double")
    ev = spark.createDataFrame([(0, 1, 1900.0, 130.0), (0, 2, 95.0, 800.0), (0, 3, 5000.0, 100.0), (0, 4, 2000.0, 9000.0)], "h bigint, id bigint, level_w double, dwell_s double")
    got = {r.id: r for r in C.classify_events(ev, lib, ["h"], ["id"], margin=1.3, plausible=True, dwell_prior=True).collect()}
    assert (got[1].device, got[1].reject) == ("kettle", None) and (got[2].device, got[2].reject) == ("fridge", None)
    assert got[3].reject == "plausibility" and got[4].reject == "dwell"
    marks = spark.createDataFrame([(i, "a", 100.0 + i, 10.0) for i in range(5)] + [(10 + i, "b", 1000.0 + i, 60.0) for i in range(5)], "id bigint, dev string, x double, y double")
    loo = C.nearest_other(marks, "dev", "id", ["x", "y"], per_label=4, seed=1).collect()
    assert len(loo) == 10 and all(r.pred == r.dev for r in loo)  # all marks, against a library of 4 a label


def test_sweep_plumbing(spark):
    base = [(0, i * 6 * S, i, 30.0 + (500.0 if (i // 20) % 3 == 1 else 0.0)) for i in range(300)]
    d = spark.createDataFrame(base, "h bigint, ts_us bigint, seq bigint, w double")
    sig = spark.createDataFrame([(0, "k", 500.0, 400.0, 520.0, 60.0, 120.0, 180.0)], "h bigint, device string, on_w double, on_p25_w double, on_p90_w double, dwell_p10_s double, dwell_p50_s double, dwell_p90_s double")
    fl = spark.createDataFrame([(0, 30.0)], "h bigint, floor_w double")
    det = SW.detect_configs(d, sig, fl, SW.EXPERIMENTS, ["h"], dt_s=6.0, rows_per_chunk=64).collect()
    by = {}
    for r in det:
        by.setdefault(r.exp, []).append((r.i_on, r.n_samples))
    assert sorted(by["E00"]) == [(20 + 60 * j, 20) for j in range(5)] and sorted(by["E06"]) == sorted(by["E00"])
    assert by["E02"] == [(20, 260)]


def test_statistics(spark):
    r = np.random.default_rng(5)
    a, b = r.gamma(2, 30, 400), r.gamma(2, 36, 300)
    mk = lambda v: spark.createDataFrame([(0, float(x)) for x in v], "k bigint, w double")
    got = ST.psi(mk(b), mk(a), ["k"]).first().psi
    e = np.quantile(a, np.linspace(0, 1, 11))
    e[0], e[-1] = -np.inf, np.inf
    pa, pb = np.clip(np.histogram(a, e)[0] / 400, 1e-6, None), np.clip(np.histogram(b, e)[0] / 300, 1e-6, None)
    assert got == pytest.approx(float(np.sum((pb - pa) * np.log(pb / pa))))
    d = spark.createDataFrame([(0, i * 60 * S, i, float(v)) for i, v in enumerate([0, 0, 700, 700, 0, 2, float("nan") if False else 3, 700])], "k bigint, ts_us bigint, seq bigint, w double")
    t = ST.on_thresholds(d, ["k"], min_samples=2).first()
    assert (t.thr_on_w, t.n_above_floor, t.on_share_pct) == (350.0, 3, 37.5)
    few = ST.on_thresholds(d, ["k"]).first()
    assert (few.thr_on_w, few.method, few.on_share_pct) == (5.0, "noise_floor", None)
    n = spark.range(4000).select(F.lit(1000.0).alias("w"), "id").select(SW.noise_variant(F.col("w"), F.col("id")).alias("v")).agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert abs(n.m - 1000) < 4 and abs(n.s - 50) < 3


def test_threshold_halves_round_in_binary(spark):
    pairs = [(114.13, 115.27), (53.79, 56.41), (15.44, 16.36), (27.69, 27.71), (10.0, 10.3)]  # halves of the medians: n.n5 and noise
    d = spark.createDataFrame([(k, i * S, i, w) for k, p in enumerate(pairs) for i, w in enumerate(p)], "k bigint, ts_us bigint, seq bigint, w double")
    got = {r.k: r.thr_on_w for r in ST.on_thresholds(d, ["k"], min_samples=2).collect()}
    con = duckdb.connect()
    for k, (lo, hi) in enumerate(pairs):
        assert got[k] == con.execute("SELECT round_even(greatest(5, 0.5 * quantile_cont(v, 0.5)), 1) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [[lo, hi]]).fetchone()[0]
