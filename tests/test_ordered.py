"""Chunked operators against plain loops, over chunk widths that cut everywhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helpers import S, by_key, episodes, frame, runs, series
from meterloom.operators import episodes as X
from meterloom.operators.energy import pair_energy, window_energy
from meterloom.operators import drift as D
from meterloom.operators.joins import asof_join, next_after, overlap_count, overlap_join, points_in
from meterloom.operators.ordered import (bucket_of, islands, join_dim, merge_intervals, ordered_scan, row_halo,
                                         suggest_chunk_us, time_halo)
from meterloom.operators.quantiles import exact_quantiles

WIDTHS = [1 * S, 7 * S, 40 * S, 10_000 * S]


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("width", WIDTHS)
def test_ordered_scan_equals_window(spark, width):
    df = frame(spark, series(1, keys=3, dup=0.2, none=0.2))
    o = ["ts_us", "seq"]
    got = ordered_scan(df, ["k"], o, bucket_of("ts_us", width), lag={"a": "w"}, lead={"b": "w"}, ffill={"c": "w"}, bfill={"d": "w"},
                       running_sum={"e": "seq"}, running_max={"f": "w"}, total={"g": "seq"}, row_number="h")
    w = W.partitionBy("k").orderBy(*o)
    up, dn = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    exp = df.select("*", F.lag("w").over(w).alias("a"), F.lead("w").over(w).alias("b"), F.last("w", True).over(up).alias("c"), F.first("w", True).over(dn).alias("d"),
                    F.sum("seq").over(up).alias("e"), F.max("w").over(up).alias("f"), F.sum("seq").over(W.partitionBy("k")).alias("g"), F.row_number().over(w).alias("h"))
    cols = ["k", "ts_us", "seq", "h", "e", "g"]
    assert rows_of(got, *cols) == rows_of(exp, *cols)
    for c in "abcdf":
        assert {(r.k, r.ts_us, r.seq): r[c] for r in got.collect()} == {(r.k, r.ts_us, r.seq): r[c] for r in exp.collect()}


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("seed", [2, 3])
def test_episodes(spark, width, seed):
    rows = series(seed, keys=4, dup=0.1, none=0.1)
    got = X.build_episodes(frame(spark, rows), ["k"], 15.0, min_dwell_s=4, merge_gap_s=6, max_hold_s=3, chunk_us=width)
    assert sorted((r.k, r.t_on_us, r.t_off_us, round(r.energy_wh, 9)) for r in got.collect()) == episodes(rows, 15.0, 4, 6, 3)


def test_episode_edges(spark):
    """First row ON, last row ON, a single ON row, all OFF, a hole inside an ON stretch."""
    rows = [(0, 0, 0, 50.0), (0, S, 1, 50.0), (0, 2 * S, 2, 0.0), (1, 0, 0, 0.0), (1, S, 1, 50.0), (2, 0, 0, 50.0), (3, 0, 0, 0.0), (3, S, 1, 1.0),
            (4, 0, 0, 50.0), (4, 7200 * S, 1, 50.0)]
    got = X.build_episodes(frame(spark, rows), ["k"], 10.0, min_dwell_s=0, merge_gap_s=0, max_hold_s=60)
    assert rows_of(got, "k", "t_on_us", "t_off_us") == [(0, 0, S), (1, S, S), (2, 0, 0), (4, 0, 7200 * S)]
    cut = X.build_episodes(frame(spark, rows), ["k"], 10.0, min_dwell_s=0, merge_gap_s=0, max_hold_s=60, max_gap_s=3600)
    assert (4, 0, 0) in rows_of(cut, "k", "t_on_us", "t_off_us")
    assert X.build_episodes(frame(spark, rows).where("k > 9"), ["k"], 10.0).count() == 0


@pytest.mark.parametrize("width", WIDTHS)
def test_hysteresis(spark, width):
    rows = series(5, keys=5)
    got = X.detect_samples(frame(spark, rows), ["k"], 40.0, 8.5, min_samples=2, chunk_us=width)
    exp = []
    for k, rs in by_key(rows).items():
        on, st = [], False
        for r in rs:
            st = True if r[3] >= 40 else False if r[3] <= 8.5 else st
            on.append(st)
        exp += [(k, a, b - a + 1) for a, b in runs(on) if b - a + 1 >= 2]
    assert rows_of(got, "k", "i_on", "n_samples") == sorted(exp)


@pytest.mark.parametrize("width", [3 * S, 10_000 * S])
def test_release_runs(spark, width):
    rows = series(6, keys=5)
    got = X.release_runs(frame(spark, rows), ["k"], on_w=60, off_w=20, chunk_us=width, rows_per_chunk=7)
    exp = []
    for k, rs in by_key(rows).items():
        w, on, below, start = [r[3] for r in rs], False, 0, 0
        for i, v in enumerate(w):
            if not on and v >= 60:
                on, start, below = True, i, 0
            elif on and v < 20:
                below += 1
                if below >= 3:
                    exp.append((k, rs[start][1], rs[i - 3][1]))
                    on = False
            elif on:
                below = 0
        if on:
            exp.append((k, rs[start][1], rs[-1][1]))
    assert rows_of(got, "k", "t0_us", "t1_us") == sorted(exp)


@pytest.mark.parametrize("seed", [7, 8])
def test_activation_runs(spark, seed):
    rows = series(seed, keys=4, n=80)
    got = X.activation_runs(frame(spark, rows), ["k"], on_w=45, off_w=30, base_s=10, chunk_us=9 * S, rows_per_chunk=11)
    exp = []
    for k, rs in by_key(rows).items():
        ts, w = [r[1] for r in rs], [r[3] for r in rs]
        n = len(w)
        sm = [np.mean(w[max(0, i - 2):i + 3]) if len(w[max(0, i - 2):i + 3]) >= 3 else np.nan for i in range(n)]
        below = [s < 30 for s in sm]
        for i in range(1, n):
            if not (sm[i] > 45 and not sm[i - 1] > 45):
                continue
            j = next((j for j in range(i, n) if below[j] and (j >= n - 3 or (below[j + 1] and below[j + 2]))), None)
            if j is None:
                continue
            pre = [w[m] for m in range(i) if ts[m] >= ts[i] - 10 * S]
            dp = max(sm[i:j + 2]) - np.median(pre) if pre else None
            exp.append((k, ts[i], ts[min(j + 1, n - 1)], None if dp is None else round(float(dp), 6)))
    assert sorted(((r.k, r.t0_us, r.t1_us, None if r.dp_w is None else round(r.dp_w, 6)) for r in got.collect()), key=str) == sorted(exp, key=str)


def test_merge_overlapping_and_chain(spark):
    r = np.random.default_rng(9)
    rows = [(int(k), int(a) * S, int(a + d) * S) for k, a, d in zip(r.integers(0, 3, 90), r.integers(0, 400, 90), r.integers(0, 30, 90))]
    df = spark.createDataFrame(rows, "k bigint, a bigint, b bigint")
    got = merge_intervals(df, ["k"], "a", "b", 3 * S, chunk_us=5 * S, overlapping=True)
    exp = []
    for k in range(3):
        cur = None
        for _, a, b in sorted(x for x in rows if x[0] == k):
            if cur and a - cur[1] <= 3 * S:
                cur = (cur[0], max(cur[1], b))
            else:
                exp += [(k, *cur)] if cur else []
                cur = (a, b)
        exp += [(k, *cur)] if cur else []
    assert rows_of(got, "k", "a", "b") == sorted(exp)


@pytest.mark.parametrize("width", WIDTHS)
def test_sessions_and_frozen_runs(spark, width):
    rows = series(10, keys=3, step_s=(1, 9), levels=(1, 1, 1, 2))
    rows = [(k, t, s, float(int(w))) for k, t, s, w in rows]
    df = frame(spark, rows)
    exp_s, exp_f = [], []
    for k, rs in by_key(rows).items():
        a = 0
        for i in range(1, len(rs) + 1):
            if i == len(rs) or rs[i][1] - rs[i - 1][1] > 5 * S:
                exp_s.append((k, rs[a][1], rs[i - 1][1]))
                a = i
        a = 0
        for i in range(1, len(rs) + 1):
            if i == len(rs) or rs[i][3] != rs[i - 1][3]:
                if i - a >= 3:
                    exp_f.append((k, rs[a][1], rs[i - 1][1], i - a))
                a = i
    assert rows_of(X.sessions(df, ["k"], 5, chunk_us=width), "k", "t0_us", "t1_us") == sorted(exp_s)
    assert rows_of(X.frozen_runs(df, ["k"], 3.0, 1.0, chunk_us=width), "k", "t0_us", "t1_us", "n_rows") == sorted(exp_f)


def test_halos(spark):
    rows = series(11, keys=2)
    h = row_halo(frame(spark, rows), ["k"], ["ts_us", "seq"], bucket_of("ts_us", 9 * S), before=2, after=1, rows_per_chunk=5).where("_own")
    assert h.count() == len(rows)
    t = time_halo(frame(spark, rows), "ts_us", 10 * S, 4 * S, 0)
    c = t.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("k", "_chunk").orderBy("ts_us").rangeBetween(-4 * S, 0))).where("_own")
    exp = [(k, r[1], r[2], sum(1 for q in rs if r[1] - 4 * S <= q[1] <= r[1])) for k, rs in by_key(rows).items() for r in rs]
    assert rows_of(c, "k", "ts_us", "seq", "n") == sorted(exp)


def test_exact_quantiles(spark):
    r = np.random.default_rng(12)
    rows = [(int(k), None if v > 95 else float(np.round(v - 20, 2)), float(v)) for k, v in zip(r.integers(0, 4, 500), r.gamma(2, 20, 500))]
    rows += [(9, None, 1.0)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double")
    got = {x.k: x for x in exact_quantiles(df, ["k"], {"a10": ("a", 0.1), "a50": ("a", 0.5), "b90": ("b", 0.9)}, {"na": "a"}).collect()}
    for k in range(4):
        a = [x[1] for x in rows if x[0] == k and x[1] is not None]
        b = [x[2] for x in rows if x[0] == k]
        assert np.allclose([got[k].a10, got[k].a50, got[k].b90], [np.percentile(a, 10), np.percentile(a, 50), np.percentile(b, 90)])
        assert got[k].na == len(a)
    assert got[9].a50 is None and got[9].na == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, direction):
    a, b = series(13, keys=2, n=60), series(14, keys=2, n=60, step_s=(2, 20))
    got = asof_join(frame(spark, a), frame(spark, b), ["k"], ["w"], tolerance_us=6 * S, direction=direction, chunk_us=11 * S)
    exp = []
    kb = by_key(b)
    for k, t, s, _ in a:
        c = [x[1] for x in kb.get(k, []) if abs(x[1] - t) <= 6 * S and (direction == "nearest" or (x[1] <= t if direction == "backward" else x[1] >= t))]
        exp.append((k, t, s, min(c, key=lambda x: (abs(x - t), -x)) if c else None))
    assert {x[:3]: x[3] for x in ((r.k, r.ts_us, r.seq, r.r_ts_us) for r in got.collect())} == {x[:3]: x[3] for x in exp}


def test_intervals(spark):
    p = series(15, keys=2, n=80)
    iv = [(k, a * S, (a + d) * S, i) for i, (k, a, d) in enumerate([(0, 5, 30), (0, 20, 3), (1, 0, 200), (1, 50, 0), (0, 33, 90)])]
    df = spark.createDataFrame(iv, "k bigint, s bigint, e bigint, id bigint")
    for salts in (1, 3):
        got = points_in(frame(spark, p), df, ["k"], start="s", end="e", bucket_us=8 * S, salts=salts)
        exp = sorted((k, t, q, i) for k, t, q, _ in p for kk, s, e, i in iv if k == kk and s <= t <= e)
        assert rows_of(got, "k", "ts_us", "seq", "id") == exp
    o = overlap_join(df, df, ["k"], left_span=("s", "e"), right_span=("s", "e"), bucket_us=8 * S, extra=F.col("l.id") < F.col("r.id"))
    exp = sorted((a[3], b[3]) for a in iv for b in iv if a[0] == b[0] and a[3] < b[3] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r.l.id, r.r.id) for r in o.collect()) == exp
    n = next_after(frame(spark, p), frame(spark, p), ["k"], [], strict=True, chunk_us=9 * S)
    ks = by_key(p)
    assert {(r.k, r.ts_us, r.seq): r.n_ts_us for r in n.collect()} == {(k, t, q): min((x[1] for x in ks[k] if x[1] > t), default=None) for k, t, q, _ in p}


def test_energy_rules(spark):
    rows = [(0, 0, 0, 100.0), (0, 6 * S, 1, 200.0), (0, 66 * S, 2, None), (0, 126 * S, 3, 50.0), (0, 726 * S, 4, 10.0)]
    df = frame(spark, rows)
    one = lambda **kw: pair_energy(df, ["k"], chunk_us=50 * S, **kw).first().energy_kwh * 3.6e6
    assert one() == pytest.approx(100 * 6 + 50 * 600)
    assert one(cap_s=60) == pytest.approx(100 * 6 + 50 * 60)
    assert one(drop_over_s=60) == pytest.approx(100 * 6)
    win = spark.createDataFrame([(0, 0, 6 * S)], "k bigint, a bigint, b bigint")
    assert window_energy(df, win, ["k"], start="a", end="b", max_hold_s=60).first().energy_wh == pytest.approx((100 * 6 + 200 * 60) / 3600)


def test_join_dim_salted(spark):
    df = frame(spark, series(16, keys=3))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, x string")
    for how in ("inner", "left"):
        a, b = join_dim(df, dim, ["k"], how, max_bytes=0), df.join(dim, ["k"], how)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert suggest_chunk_us(df, ["k"], target_rows=10**6) > 60 * S
    n = islands(df, ["k"], ["ts_us", "seq"], bucket_of("ts_us", S), row={"t": "ts_us"}, breaks=lambda p, c: F.lit(False))
    assert n.count() == 3 and n.agg(F.sum("n_rows")).first()[0] == df.count()


def test_null_keys_keep_their_rows(spark):
    rows = [(None, 1 * S, 0, 5.0), (None, 4 * S, 1, 7.0), (1, 2 * S, 0, 1.0), (1, 9 * S, 1, 3.0), (2, None, 0, 4.0)]
    d = spark.createDataFrame(rows, "k bigint, ts_us bigint, seq bigint, w double")
    got = sorted(map(tuple, ordered_scan(d, ["k"], ["ts_us", "seq"], bucket_of("ts_us", 3 * S), lag={"p": "w"}, lead={"n": "w"}, prior_max={"m": "w"}, total={"t": "w"}, row_number="i").collect()), key=str)
    want = [(None, S, 0, 5.0, None, 7.0, None, 12.0, 1), (None, 4 * S, 1, 7.0, 5.0, None, 5.0, 12.0, 2), (1, 2 * S, 0, 1.0, None, 3.0, None, 4.0, 1), (1, 9 * S, 1, 3.0, 1.0, None, 1.0, 4.0, 2), (2, None, 0, 4.0, None, None, None, 4.0, 1)]
    assert got == sorted(want, key=str)
    q = {r.k: r.m for r in exact_quantiles(d, ["k"], {"m": ("w", 0.5)}).collect()}
    assert q == {None: 6.0, 1: 2.0, 2: 4.0}


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.999])
def test_ewma_equals_the_loop(spark, width, alpha):
    rows = series(21, keys=3, n=200, dup=0.2, none=0.1)
    want = []
    for k, rs in by_key(rows).items():
        e = None
        for _, t, i, w in rs:
            if w is not None:
                e = w if e is None else alpha * w + (1 - alpha) * e
                want.append((k, t, i, e))
    got = sorted((r.k, r.ts_us, r.seq, r.e) for r in D.ewma(frame(spark, rows), ["k"], ["ts_us", "seq"], "w", alpha, chunk=bucket_of("ts_us", width), out="e").collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], rtol=1e-12)


@pytest.mark.parametrize("width", WIDTHS)
def test_cusum_equals_the_loop(spark, width):
    rows = [(k, t, i, None if w is None else w - 30) for k, t, i, w in series(22, keys=3, dup=0.2, none=0.1)]
    want = []
    for k, rs in by_key(rows).items():
        u = d = 0.0
        for _, t, i, w in rs:
            if w is not None:
                u, d = max(0.0, u + w - 4), max(0.0, d - w - 4)
            want.append((k, t, i, u, d))
    got = sorted((r.k, r.ts_us, r.seq, r.cusum_up, r.cusum_down) for r in D.cusum(frame(spark, rows), ["k"], ["ts_us", "seq"], "w", chunk=bucket_of("ts_us", width), slack=4.0).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in sorted(want)], atol=1e-9)


def spans_of(seed, n=60, most=8):
    r = np.random.default_rng(seed)
    a = r.integers(0, 60, n)
    return [(int(k), int(d), int(s) * S, int(s + x) * S, i) for i, (k, d, s, x) in enumerate(zip(r.integers(0, 3, n), r.integers(0, 3, n), a, r.integers(0, most, n)))]


@pytest.mark.parametrize("touch", [False, True])
@pytest.mark.parametrize("width", WIDTHS)
def test_overlap_count_equals_all_pairs(spark, width, touch):
    left, right = spans_of(5), spans_of(6) + [(7, 0, 0, 9 * S, 99)]
    over = (lambda a, b: a[2] <= b[3] and b[2] <= a[3]) if touch else (lambda a, b: a[2] < b[3] and b[2] < a[3])
    lf, rf = (spark.createDataFrame(x, "k bigint, dev bigint, a bigint, z bigint, id bigint").repartition(3) for x in (left, right))
    for other in (None, "dev"):
        got = overlap_count(lf, rf, ["k"], left_span=("a", "z"), right_span=("a", "z"), left_id=["id", "dev"], out="n", other=other, touch=touch, chunk_us=width)
        want = [(x[4], sum(1 for y in right if y[0] == x[0] and over(x, y) and (other is None or y[1] != x[1]))) for x in left]
        assert rows_of(got, "id", "n") == sorted(want)
    assert overlap_count(lf, rf.limit(0), ["k"], left_span=("a", "z"), right_span=("a", "z"), left_id=["id"], out="n").agg(F.sum("n")).first()[0] == 0


def test_overlap_count_on_one_crowded_key_stays_linear(spark):
    n = 20_000  # 400 million pairs
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id"), F.col("id").alias("a"), (F.col("id") + n).alias("z"))
    got = overlap_count(d, d, ["k"], left_span=("a", "z"), right_span=("a", "z"), left_id=["id"], out="n", chunk_us=1000)
    assert got.agg(F.min("n"), F.max("n")).first() == (n, n)
