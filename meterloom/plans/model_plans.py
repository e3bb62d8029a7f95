"""Queries on calibration, decoding, classification and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import calibrate as C
from ..operators import decode as D
from ..operators import episodes as X
from ..operators import matching as M
from ..operators import profiles as PR
from ..operators import resample as RS
from ..operators import stats as ST
from ..operators.joins import overlap_flag, points_in
from ..operators.ordered import DAY_US, bucket_of, join_dim, ordered_scan
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..session import cut_lineage
from .catalog import query
from .join_plans import EP_COLS, HB, presses, spans
from .match_plans import KEYS, as_units, truth_pred
from .series_plans import CH, CHANNEL_EP, H, HOLD_S, channel_episodes, episodes_sql, hyst_sql, runs_sql

CAL = 7 * DAY_US
SPLIT = 1705363200000000  # 2024-01-16 UTC

SIG_SQL = """
s0 AS (SELECT house, device, min(ts_us) AS t0 FROM channels GROUP BY 1, 2),
cal AS (SELECT c.* FROM channels c JOIN s0 ON c.house = s0.house AND c.device = s0.device WHERE ts_us < t0 + 604800000000),
p95 AS (SELECT house, device, greatest(5, 0.02 * quantile_cont(w, 0.95)) AS lim FROM cal GROUP BY 1, 2),
calm AS (SELECT cal.*, w > lim AS m FROM cal JOIN p95 ON cal.house = p95.house AND cal.device = p95.device),
""" + runs_sql("calm", "house, device", "m", name="sr") + """,
sig AS (SELECT house, device, quantile_cont(CASE WHEN m THEN w END, 0.5) AS on_w, quantile_cont(CASE WHEN m THEN w END, 0.1) AS on_p10_w, quantile_cont(CASE WHEN m THEN w END, 0.25) AS on_p25_w,
 quantile_cont(CASE WHEN m THEN w END, 0.9) AS on_p90_w, sum(w) * 3600 / 3.6e6 AS cal_energy_kwh FROM calm GROUP BY 1, 2),
dw AS (SELECT house, device, quantile_cont(n_rows * 3600e0, 0.1) AS dwell_p10_s, quantile_cont(n_rows * 3600e0, 0.5) AS dwell_p50_s, quantile_cont(n_rows * 3600e0, 0.9) AS dwell_p90_s, count(*) AS n_cal_eps
 FROM sr WHERE state = 1 AND n_rows >= 2 GROUP BY 1, 2)"""


def sigs(t):
    cal = C.first_days(t.channels, KEYS, 7).where("cal").drop("cal")
    return C.signatures(cal, KEYS, dt_s=3600.0, chunk_us=CH)


@query("m07_signatures", "house:i device:s on_w:d on_p10_w:d on_p25_w:d on_p90_w:d dwell_p10_s:d dwell_p50_s:d dwell_p90_s:d n_cal_eps:i cal_energy_kwh:d", views="channels", ctes=SIG_SQL, sql="""
SELECT sig.*, coalesce(dwell_p10_s, 0) AS dwell_p10_s, coalesce(dwell_p50_s, 0) AS dwell_p50_s, coalesce(dwell_p90_s, 0) AS dwell_p90_s, coalesce(n_cal_eps, 0) AS n_cal_eps FROM sig LEFT JOIN dw ON sig.house = dw.house AND sig.device = dw.device""")
def m07(t):
    return sigs(t)


M08_SQL = """
WITH f AS (SELECT a.*, EXISTS (SELECT 1 FROM ep b WHERE b.house = a.house AND b.device <> a.device AND b.t_on_us <= a.t_on_us + 600000000 AND b.t_off_us >= a.t_on_us - 600000000) AS fl FROM ep a),
l AS (SELECT f.house, f.device, f.t_on_us, f.dur_s, f.fl, quantile_cont(CASE WHEN m.ts_us < f.t_on_us THEN m.w END, 0.5) AS base, quantile_cont(CASE WHEN m.ts_us >= f.t_on_us THEN m.w END, 0.5) AS post FROM f LEFT JOIN mains m
 ON m.house = f.house AND m.ts_us >= f.t_on_us - 14400000000 AND m.ts_us < f.t_on_us + 7200000000 GROUP BY 1, 2, 3, 4, 5)"""


@query("m08_press_profiles", "device:s sessions:i flagged:i dp_w:d dwell_s:d", M08_SQL + """
SELECT device, count(*) AS sessions, count(*) FILTER (fl) AS flagged, quantile_cont(CASE WHEN NOT fl THEN post - base END, 0.5) AS dp_w, quantile_cont(CASE WHEN NOT fl AND post - base IS NOT NULL THEN dur_s END, 0.5) AS dwell_s FROM l GROUP BY device""",
       views="channels mains", ctes=CHANNEL_EP)
def m08(t):
    ep = channel_episodes(t).select(*EP_COLS, "dur_s")
    s = C.press_profiles(ep, t.mains, ["house"], base_s=14400, step_s=7200, pad_s=600, bucket_us=4 * HB)
    return C.class_profiles(s, ["device"])


FLOOR_SQL = "fl AS (SELECT house, quantile_cont(w, 0.1) AS floor_w FROM mains GROUP BY house)"
COVER_SQL = """
cov AS (SELECT ep.house, ep.device, ep.t_on_us, ep.t_off_us, coalesce(sum(greatest(least(ep.t_off_us, b.t_off_us) - greatest(ep.t_on_us, b.t_on_us), 0)), 0) / greatest(ep.t_off_us - ep.t_on_us, 1) AS c
 FROM ep LEFT JOIN ep b ON ep.house = b.house AND ep.device <> b.device AND ep.t_on_us < b.t_off_us AND b.t_on_us < ep.t_off_us GROUP BY 1, 2, 3, 4)"""
LEVEL_SQL = """
lev AS (SELECT v.house, v.device, v.t_on_us, v.t_off_us, avg(m.w) AS level, stddev_pop(m.w) AS sd FROM ({src}) v JOIN mains m ON m.house = v.house AND m.ts_us BETWEEN v.t_on_us + {shave} AND greatest(v.t_off_us - {shave}, v.t_on_us + {shave})
 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)"""


def mains_floor(t, until=None):
    """p10 of the mains, of the span before `until` where a split keeps the rest for tests."""
    m = t.mains if until is None else t.mains.where(F.col("ts_us") < until)
    return exact_quantiles(m, ["house"], {"floor_w": ("w", 0.1)})


@query("m09_session_params", "house:i device:s mu_w:d sd_w:d dwell_s:d p_stay:d", views="channels mains",
       ctes=CHANNEL_EP + "," + FLOOR_SQL + "," + COVER_SQL + "," + LEVEL_SQL.format(src="SELECT * FROM cov WHERE c <= 2.0", shave=600000000), sql="""
WITH g AS (SELECT lev.house, device, avg(level - floor_w) AS mu_w, greatest(avg(sd), 5) AS sd_w, least(greatest(avg((t_off_us - t_on_us) / 1e6), 30), 86400) AS dwell_s FROM lev JOIN fl ON lev.house = fl.house GROUP BY 1, 2)
SELECT *, 1 - 1 / greatest(dwell_s / 600, 1) AS p_stay FROM g WHERE mu_w >= 5""")
def m09(t):
    """Valid sessions only (other devices cover at most twice the session in this dense stream)."""
    ep = channel_episodes(t).select(*EP_COLS)
    ok = PR.cover_share(ep, ep, ["house"], 2.0, bucket_us=4 * HB).where(~F.col("flagged"))
    lv = C.session_levels(ok, t.mains, ["house"], ["device"], shave_s=600, bucket_us=4 * HB)
    return C.params_from_sessions(lv, mains_floor(t), ["house"], KEYS, 600.0)


@query("m10_passive_profile", "house:i device:s mu_w:d dwell_s:d n:i", views="channels mains", ctes=CHANNEL_EP + "," + FLOOR_SQL, sql="""
WITH v AS (SELECT ep.house, ep.device, ep.t_on_us, any_value(ep.dur_s) AS dur_s, quantile_cont(m.w, 0.5) AS md FROM ep JOIN mains m ON m.house = ep.house AND m.ts_us BETWEEN ep.t_on_us AND ep.t_off_us GROUP BY 1, 2, 3)
SELECT v.house, device, quantile_cont(md - floor_w, 0.5) AS mu_w, least(greatest(quantile_cont(dur_s, 0.5), 30), 86400) AS dwell_s, count(*) AS n FROM v JOIN fl ON v.house = fl.house GROUP BY 1, 2""")
def m10(t):
    """Median over duty intervals of the median mains inside, above the floor."""
    ep = channel_episodes(t).select(*EP_COLS)
    v = PR.readings_in(t.mains, ep, ["house"], ["device", "t_on_us", "t_off_us"], bucket_us=4 * HB)
    v = join_dim(v, mains_floor(t), ["house"]).select("house", "device", (F.col("med_w") - F.col("floor_w")).alias("x"), ((F.col("t_off_us") - F.col("t_on_us")) / 1e6).alias("dur_s"))
    q = exact_quantiles(v, KEYS, {"mu_w": ("x", 0.5), "d": ("dur_s", 0.5)}, {"n": "x"})
    return q.withColumn("dwell_s", C.clamp(F.col("d"), 30, 86400))


@query("m11_pre_press_level", "house:i device:s press_us:i level_w:d", views="channels mains", sql="""
WITH pr AS (SELECT house, device, ts_us AS press_us FROM channels WHERE w < 12)
SELECT pr.house, pr.device, press_us, CASE WHEN count(m.w) >= 3 THEN quantile_cont(m.w, 0.5) ELSE 0 END AS level_w FROM pr LEFT JOIN mains m ON m.house = pr.house AND m.ts_us >= press_us - 7200000000 AND m.ts_us < press_us - 600000000 GROUP BY 1, 2, 3""")
def m11(t):
    """Level before each press; presses of one device at one stamp are one."""
    p = presses(t).distinct()
    lv = C.pre_press_level(p.select("house", "press_us").distinct(), t.mains, ["house"], span_s=7200, gap_s=600, bucket_us=HB)
    return p.join(lv, ["house", "press_us"])


def param_grid(t, ks=(1, 3, 5), n_draws=2):
    """(house, k, draw, device) parameters from hash draws of valid sessions; devices
    without a separable level get a row that never claims."""
    ep = cut_lineage(channel_episodes(t).where(F.col("t_on_us") < SPLIT).select(*EP_COLS))
    cov = PR.cover_share(ep, ep, ["house"], 2.0, bucket_us=4 * HB)
    drawn = C.draw_sessions(cov, KEYS, "flagged", ks, n_draws, 20260922)
    lv = C.session_levels(cov, t.mains.where(F.col("ts_us") < SPLIT), ["house"], ["device"], shave_s=600, bucket_us=4 * HB)
    use = drawn.join(lv, [*KEYS, "t_on_us", "t_off_us"])
    fl = cut_lineage(mains_floor(t, SPLIT))
    est = C.params_from_sessions(use, fl, ["house"], [*KEYS, "k", "draw"], 600.0)
    yield_ = drawn.groupBy(*KEYS, "k", "draw").agg(F.count(F.lit(1)).alias("valid"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("draw")) for k in ks for r in range(n_draws)]))
    grid = ep.select(*KEYS).distinct().select(*KEYS, cells.alias("z")).select(*KEYS, "z.*")
    j = grid.join(est, [*KEYS, "k", "draw"], "left").join(yield_, [*KEYS, "k", "draw"], "left").join(fl, "house")
    return j.select(*KEYS, "k", "draw", F.coalesce("mu_w", "floor_w").alias("mu_w"), F.coalesce("sd_w", F.lit(5.0)).alias("sd_w"),
                    F.coalesce("p_stay", F.lit(1.0 - 600.0 / 3600.0)).alias("p_stay"), F.coalesce("valid", F.lit(0)).alias("valid"), F.col("mu_w").isNull().alias("never_claims"), "floor_w")


@query("m12_param_grid", "house:i device:s k:i draw:i mu_w:d sd_w:d p_stay:d valid:i never_claims:b")
def m12(t):
    return param_grid(t)


def param_rows(t, **kw):
    """The grid as one array-valued row per (house, row_id)."""
    g = param_grid(t, **kw)
    sig = ST.robust_noise(t.mains.where(F.col("ts_us") < SPLIT), ["house"]).select("house", "sigma_off_w")
    arr = F.array_sort(F.collect_list(F.struct("device", "mu_w", "sd_w", "p_stay")))  # one entry per device
    p = g.groupBy("house", "k", "draw").agg(arr.alias("a"), F.first("floor_w").alias("floor_w")).join(sig, "house")
    pick = lambda c: F.transform("a", lambda x: x[c])
    rid = F.row_number().over(W.partitionBy("house").orderBy("k", "draw")) - 1
    return p.select("house", "k", "draw", rid.cast("bigint").alias("row_id"), pick("device").alias("devices"), pick("mu_w").alias("mu"), pick("sd_w").alias("sd"), pick("p_stay").alias("p_stay"),
                    F.col("sigma_off_w").alias("sigma_off"), "floor_w")


def decoded(t, ks=(3,), n_draws=1):
    par = cut_lineage(param_rows(t, ks=ks, n_draws=n_draws))
    test = t.mains.where(F.col("ts_us") >= SPLIT)
    return par, D.decode(test, par, ["house"], cadence_s=600.0, chunk_steps=2048, warm_steps=64)


@query("m13_joint_decode", "house:i ts_us:i device:s on:i marg:d4 gated:i")
def m13(t):
    return decoded(t)[1]


@query("m14_claim_episodes", "house:i device:s t_on_us:i t_off_us:i dur_s:d")
def m14(t):
    _, dec = decoded(t)
    d = cut_lineage(dec).withColumn("w", F.lit(1.0))
    return X.gated_episodes(d, KEYS, D.claimed(), F.col("gated") == 1, merge_gap_s=7200, min_dwell_s=600, gate_split_rows=2, chunk_us=CH)


@query("m15_claimed_power", "house:i device:s n:i mean_w:d claim_share:d")
def m15(t):
    par, dec = decoded(t)
    lv = par.select("house", "row_id", F.explode(F.arrays_zip("devices", "mu")).alias("z")).select("house", "row_id", F.col("z.devices").alias("device"), F.col("z.mu").alias("mu"))
    d = join_dim(dec, lv, ["house", "row_id", "device"])
    return d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(D.claimed_power(F.col("mu"))).alias("mean_w"), F.avg(D.claimed().cast("int")).alias("claim_share"))


@query("m16_anchor_power", "house:i device:s n:i claimed_wh:d", views="channels mains", ctes=CHANNEL_EP, sql="""
SELECT ep.house, ep.device, count(*) AS n, sum(m.w) AS claimed_wh FROM ep JOIN mains m ON m.house = ep.house AND m.ts_us BETWEEN ep.t_on_us AND ep.t_off_us GROUP BY 1, 2""")
def m16(t):
    """Aggregate inside claimed spans; overlapping devices count twice."""
    ep = channel_episodes(t).select(*EP_COLS)
    return points_in(t.mains.select("house", "ts_us", "w"), ep, ["house"], start="t_on_us", end="t_off_us", bucket_us=4 * HB).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("claimed_wh"))


@query("m17_cadence_rescale", "device:s p_stay_60:d sd_60:d", views="devices", sql="""
SELECT device, 1 - (1 - p) * (6.0 / 60) AS p_stay_60, sqrt(greatest(sd * sd - 25, 0) + 4) AS sd_60 FROM (SELECT device, avg(CASE WHEN w > 40 THEN 1.0 ELSE 0.0 END) AS p, stddev_pop(w) AS sd FROM devices GROUP BY device)""")
def m17(t):
    g = t.devices.groupBy("device").agg(F.avg((F.col("w") > 40).cast("double")).alias("p"), F.stddev_pop("w").alias("sd"))
    return g.select("device", D.rescale_stay(F.col("p"), 6.0, 60.0).alias("p_stay_60"), D.rescale_sd(F.col("sd"), F.lit(5.0), F.lit(2.0)).alias("sd_60"))


@query("m18_em_fit", "house:i component:i mu:d3 sd:d3 p_stay:d")
def m18(t):
    noise = ST.robust_noise(t.mains.where(F.col("ts_us") < SPLIT), ["house"]).withColumnRenamed("sigma_off_w", "sigma_off")
    fit = D.em_fit(t.mains.where(F.col("ts_us") < SPLIT), ["house"], ["c1", "c2"], cut_lineage(noise), cadence_s=600.0, iters=2, restarts=2, chunk_steps=2048, warm_steps=64)
    return fit.select("house", F.posexplode(F.arrays_zip("mu", "sd", "p_stay")).alias("component", "z")).select("house", "component", "z.*")


@query("m19_assignment", "house:i component:i device:i cost:d", sql="""
WITH m AS (SELECT user_id % 5 AS house, avg(value) FILTER (event_type = 'click') AS a0, avg(value) FILTER (event_type = 'view') AS a1, avg(value) FILTER (event_type = 'error') AS a2,
 avg(value) FILTER (event_type = 'signup' AND value > 5) AS b0, avg(value) FILTER (event_type = 'purchase' AND value > 5) AS b1, avg(value) FILTER (event_type = 'purchase' AND value > 1) AS b2 FROM events GROUP BY 1),
p AS (SELECT house, p0, p1, p2, abs(a0 - [b0, b1, b2][p0 + 1]) + abs(a1 - [b0, b1, b2][p1 + 1]) + abs(a2 - [b0, b1, b2][p2 + 1]) AS cost FROM m, (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)) v(p0, p1, p2)),
b AS (SELECT house, min(cost) AS cost, min_by([p0, p1, p2], (cost, p0, p1, p2)) AS pm FROM p GROUP BY house)
SELECT house, unnest([0, 1, 2]) AS component, unnest(pm) AS device, cost FROM b""")
def m19(t):
    """Cheapest one-to-one assignment of the levels of three components to three devices, by a fold over the sets of places in use."""
    d = t.channels
    lv = lambda n, lo: F.avg(F.when((F.col("device") == n) & (F.col("w") > lo), F.col("w")))
    m = d.groupBy("house").agg(F.array(lv("click", -1), lv("view", -1), lv("error", -1)).alias("a"), F.array(lv("signup", 5), lv("purchase", 5), lv("purchase", 1)).alias("b"))
    best = m.select("house", M.cheapest_assignment(F.col("a"), F.col("b"), lambda x, y: F.abs(x - y)).alias("z"))
    return best.select("house", "z.cost", F.posexplode("z.chosen").alias("component", "device"))


def em_params(t, par):
    """Levels fitted without sessions on the 30 days before the split, one component for each device of the last
    parameter row: the cheapest assignment by level. One row per house, in the form of `param_rows`."""
    train = t.mains.where((F.col("ts_us") >= SPLIT - 30 * DAY_US) & (F.col("ts_us") < SPLIT))
    names = [f"c{i}" for i in range(5)]
    noise = cut_lineage(par.select("house", "floor_w", "sigma_off").distinct())
    fit = cut_lineage(D.em_fit(train, ["house"], names, noise, cadence_s=600.0, chunk_steps=2048, warm_steps=64))
    last = par.groupBy("house").agg(F.max_by(F.struct("devices", F.col("mu").alias("hat"), "sigma_off", "floor_w"), "row_id").alias("z")).select("house", "z.*")
    x = fit.select("house", "mu", "sd", "p_stay").join(last, "house").withColumn("pm", M.cheapest_assignment(F.col("hat"), F.col("mu"), lambda x, y: F.abs(x - y))["chosen"])
    at = F.sequence(F.lit(0), F.size("devices") - 1)
    own = lambda c: F.transform(at, lambda i: F.get(F.col(c), F.get(F.col("pm"), i))).alias(c)
    best = x.select("house", F.struct("devices", own("mu"), own("sd"), own("p_stay"), "sigma_off", "floor_w").alias("z"))
    return best.select("house", F.lit(0).alias("k"), F.lit(0).alias("draw"), F.lit(0).cast("bigint").alias("row_id"), "z.*")


@query("m20_k_curve", "arm:s cadence_s:i k:i n_rows:i f1_mean:d f1_std:d")
def m20(t):
    """Anchor, session-supervised and EM arms in one table: pooled F1 per arm, cadence and K."""
    ep = cut_lineage(channel_episodes(t).where(F.col("t_on_us") >= SPLIT).select(*EP_COLS))
    test = t.mains.where(F.col("ts_us") >= SPLIT)
    par = cut_lineage(param_rows(t, ks=(1, 3), n_draws=2))
    sources = [("sessions", par), ("em", cut_lineage(em_params(t, par)))]
    hourly = RS.bucket_resample(test, ["house"], 3600, stamp="mid").select("house", "ts_us", F.lit(0).cast("bigint").alias("seq"), "w")
    arms = []
    for cad, series in ((600, test), (3600, hourly)):
        for arm, rows in sources:
            p = rows.withColumn("p_stay", F.transform("p_stay", lambda x: D.rescale_stay(x, 600.0, float(cad)))) if cad != 600 else rows  # noqa: B023
            runs = D.decode_runs(series, p, ["house"], cadence_s=float(cad), chunk_steps=2048, warm_steps=64)
            runs = cut_lineage(runs.join(rows.select("house", "row_id", "k", "draw"), ["house", "row_id"]))
            e = X.run_episodes(runs, ["house", "k", "draw", "device"], merge_gap_s=7200, min_dwell_s=600, gate_split_rows=2, chunk_us=CH)
            arms.append(e.select(F.lit(arm).alias("arm"), F.lit(cad).alias("cadence_s"), "k", "draw", *EP_COLS))
        a = X.anchor_episodes(series, ["house"], 60.0, min_dwell_s=600, merge_gap_s=7200, hold_s=HOLD_S, chunk_us=CH)
        a = a.join(ep.select(*KEYS).distinct(), "house")
        arms.append(a.select(F.lit("anchor").alias("arm"), F.lit(cad).alias("cadence_s"), F.lit(0).alias("k"), F.lit(0).alias("draw"), *EP_COLS))
    pred = arms[0]
    for a in arms[1:]:
        pred = pred.unionByName(a)
    pred = cut_lineage(pred)
    run = ["arm", "cadence_s", "k", "draw"]
    every = [(a, c, k, r) for c in (600, 3600) for a, k, r in [("anchor", 0, 0), ("em", 0, 0), *[("sessions", k, r) for k in (1, 3) for r in (0, 1)]]]
    z = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(run, e)]) for e in every]))
    truth = ep.select("*", z.alias("z")).select(*EP_COLS, "z.*")
    m = M.match_onsets(truth, pred, [*run, *KEYS], 3 * H, chunk_us=CH).where(M.in_dwell_band())
    s = M.score(truth, pred, m, run)
    return s.groupBy("arm", "cadence_s", "k").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"))


@query("m21_separability", "device:s margin:d verdict:s", views="devices", sql="""
WITH q AS (SELECT device, avg(CASE WHEN w > 30 THEN w END) AS mu, quantile_cont(w, 0.1) AS fl, stddev_pop(CASE WHEN w <= 30 THEN w END) AS sd FROM devices GROUP BY device)
SELECT device, (mu - fl) / sd AS margin, CASE WHEN (mu - fl) / sd >= 4 THEN 'clear' WHEN (mu - fl) / sd >= 2 THEN 'marginal' ELSE 'sub-noise' END AS verdict FROM q""")
def m21(t):
    g = t.devices.groupBy("device").agg(F.avg(F.when(F.col("w") > 30, F.col("w"))).alias("mu"), F.stddev_pop(F.when(F.col("w") <= 30, F.col("w"))).alias("sd"))
    g = g.join(exact_quantiles(t.devices, ["device"], {"fl": ("w", 0.1)}), "device")
    return g.select("device", *C.separability(F.col("mu"), F.col("fl"), F.col("sd")))


@query("o06_session_draws", "house:i device:s k:i draw:i n_kept:i n_flagged:i max_slot:i", views="channels", ctes=CHANNEL_EP, sql="""
WITH p AS (SELECT a.house, a.device, a.t_on_us, sum(least(a.t_off_us, b.t_off_us) - greatest(a.t_on_us, b.t_on_us)) AS ov
 FROM ep a JOIN ep b ON a.house = b.house AND a.device <> b.device AND a.t_on_us < b.t_off_us AND b.t_on_us < a.t_off_us GROUP BY 1, 2, 3),
c AS (SELECT ep.house, ep.device, ep.t_on_us, coalesce(ov, 0) / greatest(ep.t_off_us - ep.t_on_us, 1) > 2.0 AS flagged,
 row_number() OVER (PARTITION BY ep.house, ep.device ORDER BY ep.t_on_us) AS i, count(*) OVER (PARTITION BY ep.house, ep.device) AS size FROM ep LEFT JOIN p USING (house, device, t_on_us)),
b AS (SELECT DISTINCT house, device, size FROM c), k AS (SELECT unnest([1, 3, 5]) AS k), r AS (SELECT unnest(range(3)) AS draw),
s AS (SELECT house, device, size, k, draw, unnest(range((greatest(4 * k, 8) + k - 1) // k * k)) AS slot FROM b, k, r),
d AS (SELECT s.house, s.device, k, draw, slot, flagged FROM s JOIN c ON c.house = s.house AND c.device = s.device AND c.i = ('0x' || left(md5('20260922:' || k || ':' || draw || ':' || slot || ':' || s.house || ':' || s.device), 12))::BIGINT % s.size + 1),
g AS (SELECT *, count(*) FILTER (NOT flagged) OVER (PARTITION BY house, device, k, draw ORDER BY slot) AS good FROM d)
SELECT house, device, k, draw, count(*) AS n_kept, 0 AS n_flagged, max(slot) AS max_slot FROM g WHERE NOT flagged AND good <= k GROUP BY 1, 2, 3, 4""")
def o06(t):
    """Draws with replacement until k unflagged sessions, at most max(4k, 8) tries."""
    ep = channel_episodes(t).select(*EP_COLS)
    cov = PR.cover_share(ep, ep, ["house"], 2.0, bucket_us=4 * HB)
    d = C.draw_sessions(cov, KEYS, "flagged", (1, 3, 5), 3, 20260922)
    return d.groupBy(*KEYS, "k", "draw").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("flagged").alias("n_flagged"), F.max("slot").alias("max_slot"))
