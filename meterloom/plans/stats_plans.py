"""Queries on channel statistics, audits and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import episodes as X
from ..operators import resample as RS
from ..operators import stats as ST
from ..operators.ordered import DAY_US, bucket_of, islands, join_dim, ordered_scan
from ..operators.quantiles import exact_quantiles, with_quantiles
from .catalog import query
from .series_plans import CH, CHANNEL_EP, H, channel_episodes

DT = "g AS (SELECT *, (lead(ts_us) OVER (PARTITION BY {k} ORDER BY ts_us, seq) - ts_us) / 1e6 AS dt FROM {s})"
DT_DEV, DT_RD = DT.format(k="device", s="devices"), DT.format(k="meter", s="readings")


@query("a01_cadence", "device:s dt_med_s:d3 dt_p90_s:d3 n_gaps:i", views="devices", ctes=DT_DEV, sql="""
SELECT device, quantile_cont(dt, 0.5) AS dt_med_s, quantile_cont(dt, 0.9) AS dt_p90_s, count(*) AS n_gaps FROM g WHERE dt > 0 GROUP BY device""")
def a01(t):
    return ST.cadence(t.devices, ["device"])


@query("a01_modal_gap", "device:s modal_dt_s:d", views="devices", ctes=DT_DEV, sql="""
WITH c AS (SELECT device, round_even(dt / 60, 0) AS d, count(*) AS c FROM g WHERE dt > 0 AND dt < 3600 GROUP BY 1, 2)
SELECT device, max_by(d, (c, -d)) AS modal_dt_s FROM c GROUP BY device""")
def a01_modal(t):
    """Gaps counted in minutes."""
    g = X.gaps(t.devices, ["device"]).where("dt_s > 0 and dt_s < 3600")
    c = g.groupBy("device", F.bround(F.col("dt_s") / 60, 0).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("device").agg(F.max_by("d", F.struct("c", -F.col("d"))).alias("modal_dt_s"))


@query("a02_fill", "meter:i n:i dt_med_s:d fill:d", views="readings", ctes=DT_RD, sql="""
SELECT meter, count(*) AS n, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS dt_med_s,
 count(*) / ((max(ts_us) - min(ts_us)) / 1e6 / quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) + 1) AS fill FROM g GROUP BY meter""")
def a02(t):
    return ST.fill_share(t.readings, ["meter"], chunk_us=CH)


@query("a03_gap_fraction", "meter:i gap_frac:d", views="readings", ctes=DT_RD, sql="""
WITH m AS (SELECT meter, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS md FROM g GROUP BY meter)
SELECT g.meter, avg(CASE WHEN dt > greatest(3, 3 * md) THEN 1.0 ELSE 0.0 END) AS gap_frac FROM g JOIN m ON g.meter = m.meter WHERE dt IS NOT NULL GROUP BY g.meter""")
def a03(t):
    return ST.gap_fraction(t.readings, ["meter"], 3.0, least_s=3.0, chunk_us=CH)


@query("a04_on_thresholds", "device:s thr_on_w:d p50_on_w:d n_above_floor:i method:s on_share_pct:d", views="devices", sql="""
WITH q AS (SELECT device, count(*) AS n, count(*) FILTER (w > 5) AS n_above_floor, quantile_cont(CASE WHEN w > 5 THEN w END, 0.5) AS p50 FROM devices GROUP BY device),
r AS (SELECT *, CASE WHEN n_above_floor < 100 THEN 5.0 ELSE round_even(greatest(5, 0.5 * p50), 1) END AS thr_on_w FROM q)
SELECT r.device, any_value(thr_on_w) AS thr_on_w, any_value(round_even(p50, 1)) AS p50_on_w, any_value(n_above_floor) AS n_above_floor, 'half_p50' AS method,
 round_even(100.0 * count(*) FILTER (w > thr_on_w) / count(*), 2) AS on_share_pct FROM r JOIN devices d ON r.device = d.device GROUP BY r.device""")
def a04(t):
    return ST.on_thresholds(t.devices, ["device"])


@query("a04_on_thresholds_few", "meter:i thr_on_w:d n_above_floor:i method:s", views="readings", sql="""
WITH q AS (SELECT meter, count(*) FILTER (w > 5) AS n, quantile_cont(CASE WHEN w > 5 THEN w END, 0.5) AS p50 FROM readings GROUP BY meter)
SELECT meter, CASE WHEN n < 60 THEN 5.0 ELSE round_even(greatest(5, 0.5 * p50), 1) END AS thr_on_w, n AS n_above_floor,
 CASE WHEN n < 60 THEN 'noise_floor' ELSE 'half_p50' END AS method FROM q""")
def a04_few(t):
    return ST.on_thresholds(t.readings, ["meter"], min_samples=60)


@query("a05_floor_thresholds", "device:s floor_w:d p50_on_w:d thr_on_w:d", views="devices", sql="""
WITH f AS (SELECT device, quantile_cont(w, 0.05) AS floor_w FROM devices GROUP BY device),
p AS (SELECT d.device, any_value(floor_w) AS floor_w, quantile_cont(CASE WHEN w > floor_w + 5 THEN w END, 0.5) AS p50 FROM devices d JOIN f ON d.device = f.device GROUP BY d.device)
SELECT device, floor_w, coalesce(p50, floor_w + 5) AS p50_on_w, floor_w + greatest(5, 0.5 * (coalesce(p50, floor_w + 5) - floor_w)) AS thr_on_w FROM p""")
def a05(t):
    return ST.floor_thresholds(t.devices, ["device"])


@query("a06_on_mask", "device:s p95_w:d n_on:i", views="devices", sql="""
WITH q AS (SELECT device, quantile_cont(w, 0.95) AS p95_w FROM devices GROUP BY device)
SELECT q.device, any_value(p95_w) AS p95_w, count(*) FILTER (w > greatest(5, 0.02 * p95_w)) AS n_on FROM q JOIN devices d ON q.device = d.device GROUP BY q.device""")
def a06(t):
    d = ST.on_level(t.devices, ["device"])
    return d.groupBy("device").agg(F.max("p95_w").alias("p95_w"), F.count_if("on").alias("n_on"))


BATTERY = """
bq AS (SELECT device, count(*) AS n, count(*) FILTER (w IS NULL) AS n_missing, count(*) FILTER (w < 0) AS n_neg, min(w) AS vmin, max(w) AS vmax, avg(w) AS mean_w, sum(w) AS sw,
  quantile_cont(w, 0.05) AS floor_w, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS dt_med_s, (max(ts_us) - min(ts_us)) / 86400e6 AS span_days,
  quantile_cont(CASE WHEN w > 5 THEN w END, 0.5) AS p50_on_w, greatest(5, 0.5 * quantile_cont(CASE WHEN w > 5 THEN w END, 0.5)) AS thr_on_w FROM g GROUP BY device),
bs AS (SELECT d.device, row_number() OVER (PARTITION BY d.device ORDER BY ts_us, seq) - 1 AS i, CASE WHEN w > thr_on_w THEN 1 ELSE 0 END AS st FROM devices d JOIN bq ON d.device = bq.device),
bb AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY device ORDER BY i) THEN 0 ELSE 1 END AS brk FROM bs),
bc AS (SELECT *, sum(brk) OVER (PARTITION BY device ORDER BY i) AS rid FROM bb),
bd AS (SELECT device, min(i) AS s, max(i) + 1 AS e FROM bc WHERE st = 1 GROUP BY device, rid),
bf AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY device ORDER BY s) <= 2 THEN 0 ELSE 1 END AS brk FROM bd),
bg AS (SELECT *, sum(brk) OVER (PARTITION BY device ORDER BY s) AS gid FROM bf),
bh AS (SELECT device, gid, max(e) - min(s) AS n FROM bg GROUP BY device, gid),
be AS (SELECT device, count(*) AS episodes, quantile_cont(n, 0.1) AS d10, quantile_cont(n, 0.5) AS d50, quantile_cont(n, 0.9) AS d90 FROM bh GROUP BY device),
bo AS (SELECT device, avg(st) AS on_share FROM bs GROUP BY device),
battery AS (SELECT bq.*, on_share, sw * dt_med_s / 3.6e6 AS energy_kwh, episodes, episodes / greatest(span_days, 1e-9) AS episodes_per_day,
  d10 * dt_med_s AS dwell_p10_s, d50 * dt_med_s AS dwell_p50_s, d90 * dt_med_s AS dwell_p90_s FROM bq JOIN be ON bq.device = be.device JOIN bo ON bq.device = bo.device)"""


@query("a07_channel_battery", "device:s n:i n_missing:i n_neg:i vmin:d vmax:d mean_w:d floor_w:d dt_med_s:d span_days:d p50_on_w:d thr_on_w:d on_share:d "
       "energy_kwh:d episodes:i episodes_per_day:d dwell_p10_s:d dwell_p50_s:d dwell_p90_s:d", views="devices", ctes=DT_DEV + "," + BATTERY, sql="SELECT * FROM battery")
def a07(t):
    return ST.channel_battery(t.devices, ["device"])


@query("a08_scan_groups", "house:i kind:s slot:i n:i mean_w:d", views="mains", sql="""
WITH t AS (SELECT house, min(ts_us) AS t0 FROM mains GROUP BY house),
d AS (SELECT m.house, w, (ts_us // 3600000000 + 1) % 24 AS hour, (ts_us // 86400000000 + 3) % 7 AS weekday, least(floor(w / 5), 1199) AS bin,
  CASE WHEN ts_us < t0 + 21 * 86400000000 THEN (ts_us - t0) // 60000000 END AS minute FROM mains m JOIN t ON m.house = t.house)
SELECT house, 'hour' AS kind, hour AS slot, count(*) AS n, sum(w) / count(*) AS mean_w FROM d GROUP BY 1, 2, 3
UNION ALL SELECT house, 'weekday', weekday, count(*), sum(w) / count(*) FROM d GROUP BY 1, 2, 3
UNION ALL SELECT house, 'bin', bin, count(*), sum(w) / count(*) FROM d GROUP BY 1, 2, 3
UNION ALL SELECT house, 'minute', minute, count(*), sum(w) / count(*) FROM d WHERE minute IS NOT NULL GROUP BY 1, 2, 3""")
def a08(t):
    return ST.scan_groups(t.mains, ["house"], offset_h=1)


@query("a08_scan_totals", "house:i n:i vmin:d vmax:d total_w:d s30:i s100:i s300:i p01:d p05:d p10:d p25:d p50:d p75:d p90:d p95:d p99:d", views="mains", sql="""
WITH a AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY house ORDER BY ts_us, seq)) AS d FROM mains)
SELECT house, count(*) AS n, min(w) AS vmin, max(w) AS vmax, sum(w) AS total_w, count(*) FILTER (d >= 30) AS s30, count(*) FILTER (d >= 100) AS s100, count(*) FILTER (d >= 300) AS s300,
""" + ", ".join(f"quantile_cont(w, {p / 100}) AS p{p:02d}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM a GROUP BY house")
def a08_totals(t):
    m = t.mains
    tot = m.groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("vmin"), F.max("w").alias("vmax"), F.sum("w").alias("total_w"))
    st = ST.step_counts(m, ["house"]).select("house", F.col("steps_30").alias("s30"), F.col("steps_100").alias("s100"), F.col("steps_300").alias("s300"))
    q = exact_quantiles(m, ["house"], {f"p{p:02d}": ("w", p / 100) for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)})
    return tot.join(st, "house").join(q, "house")


@query("a09_thinned_quantiles", "house:i p50:d p95:d n:i", views="mains", sql="""
SELECT house, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.95) AS p95, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) - 1 AS i FROM mains)
WHERE i % 3 = 0 GROUP BY house""")
def a09(t):
    """Stride thinning (the operator itself); `a08_scan_totals` has the full-data quantiles."""
    d = X.numbered(t.mains, ["house"]).where("i % 3 = 0")
    return exact_quantiles(d, ["house"], {"p50": ("w", 0.5), "p95": ("w", 0.95)}, {"n": "w"})


@query("a10_always_on_floor", "house:i always_on_w:d", views="mains", sql="""
SELECT house, quantile_cont(p10, 0.5) AS always_on_w FROM (SELECT house, ts_us // 86400000000 AS day, quantile_cont(w, 0.1) AS p10 FROM mains GROUP BY 1, 2) GROUP BY house""")
def a10(t):
    return ST.always_on_floor(t.mains, ["house"])


@query("a11_robust_noise", "house:i floor_w:d sigma_off_w:d", views="mains", sql="""
WITH f AS (SELECT house, quantile_cont(w, 0.1) AS floor_w, quantile_cont(w, 0.5) AS md FROM mains GROUP BY house)
SELECT a.house, any_value(floor_w) AS floor_w, greatest(1.4826 * quantile_cont(abs(w - md), 0.5), 1) AS sigma_off_w FROM mains a JOIN f ON a.house = f.house GROUP BY a.house""")
def a11(t):
    return ST.robust_noise(t.mains, ["house"])


@query("a12_bucket_resample", "house:i device:s ts_us:i w:d w_max:d n:i", views="channels", sql="""
SELECT house, device, ts_us // 3600000000 * 3600000000 + 1800000000 AS ts_us, avg(w) AS w, max(w) AS w_max, count(w) AS n FROM channels GROUP BY 1, 2, 3""")
def a12(t):
    return RS.bucket_resample(t.channels, ["house", "device"], 3600, stamp="mid")


GRID = """
gr AS (SELECT house, device, ts_us // 21600000000 AS b, avg(w) AS w FROM channels GROUP BY 1, 2, 3),
gs AS (SELECT house, device, unnest(generate_series(min(b), max(b))) AS b FROM gr GROUP BY 1, 2)"""


@query("a13_dense_grid", "house:i device:s ts_us:i w:d", views="channels", ctes=GRID, sql="""
SELECT gs.house, gs.device, gs.b * 21600000000 AS ts_us, w FROM gs LEFT JOIN gr ON gs.house = gr.house AND gs.device = gr.device AND gs.b = gr.b""")
def a13(t):
    return RS.dense_grid(t.channels, ["house", "device"], 21600)


@query("a14_zero_filled_grid", "house:i device:s n:i mean_w:d", views="channels", ctes=GRID, sql="""
SELECT gs.house, gs.device, count(*) AS n, avg(coalesce(w, 0)) AS mean_w FROM gs LEFT JOIN gr ON gs.house = gr.house AND gs.device = gr.device AND gs.b = gr.b GROUP BY 1, 2""")
def a14(t):
    return RS.dense_grid(t.channels, ["house", "device"], 21600, fill=0.0).groupBy("house", "device").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))


@query("a15_diurnal", "house:i peak_hour:i trough_hour:i peak_over_trough:d", views="mains", sql="""
WITH h AS (SELECT house, (ts_us // 3600000000) % 24 AS hr, avg(w) AS m FROM mains GROUP BY 1, 2)
SELECT house, max_by(hr, (m, -hr)) AS peak_hour, min_by(hr, (m, hr)) AS trough_hour, max(m) / greatest(min(m), 1e-9) AS peak_over_trough FROM h GROUP BY house""")
def a15(t):
    h = t.mains.groupBy("house", F.pmod(bucket_of("ts_us", H), F.lit(24)).alias("hr")).agg(F.avg("w").alias("m"))
    return h.groupBy("house").agg(F.max_by("hr", F.struct("m", -F.col("hr"))).alias("peak_hour"), F.min_by("hr", F.struct("m", "hr")).alias("trough_hour"),
                                  (F.max("m") / F.greatest(F.min("m"), F.lit(1e-9))).alias("peak_over_trough"))


@query("a16_weekday_weekend", "house:i weekday_w:d weekend_w:d", views="mains", sql="""
SELECT house, avg(CASE WHEN (ts_us // 86400000000 + 3) % 7 < 5 THEN w END) AS weekday_w, avg(CASE WHEN (ts_us // 86400000000 + 3) % 7 >= 5 THEN w END) AS weekend_w FROM mains GROUP BY house""")
def a16(t):
    we = F.pmod(bucket_of("ts_us", DAY_US) + 3, F.lit(7)) >= 5
    return t.mains.groupBy("house").agg(F.avg(F.when(~we, F.col("w"))).alias("weekday_w"), F.avg(F.when(we, F.col("w"))).alias("weekend_w"))


@query("a17_onset_hours", "device:s weekend:i " + " ".join(f"h{h}:i" for h in range(24)), views="channels", ctes=CHANNEL_EP, sql="SELECT device, CASE WHEN (t_on_us // 86400000000 + 3) % 7 >= 5 THEN 1 ELSE 0 END AS weekend, "
       + ", ".join(f"count(*) FILTER ((t_on_us // 3600000000) % 24 = {h}) AS h{h}" for h in range(24)) + " FROM ep GROUP BY 1, 2")
def a17(t):
    ep = channel_episodes(t)
    we = (F.pmod(bucket_of("t_on_us", DAY_US) + 3, F.lit(7)) >= 5).cast("int").alias("weekend")
    p = ep.select("device", we, F.pmod(bucket_of("t_on_us", H), F.lit(24)).alias("hr")).groupBy("device", "weekend").pivot("hr", list(range(24))).count().fillna(0)
    return p.select("device", "weekend", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


@query("a18_on_probability", "device:s hr:i p_on:d", views="devices", ctes=DT_DEV, sql="""
SELECT device, (ts_us // 3600000000) % 24 AS hr, sum(CASE WHEN w > 40 THEN least(dt, 1800) ELSE 0 END) / sum(least(dt, 1800)) AS p_on FROM g WHERE dt IS NOT NULL GROUP BY 1, 2""")
def a18(t):
    g = X.gaps(t.devices, ["device"]).withColumn("c", F.least("dt_s", F.lit(1800.0)))
    return g.groupBy("device", F.pmod(bucket_of("ts_us", H), F.lit(24)).alias("hr")).agg(
        (F.sum(F.when(F.col("w") > 40, F.col("c")).otherwise(0.0)) / F.sum("c")).alias("p_on"))


@query("a19_weekly_duty", "device:s wk:i duty:d band_share:d", views="devices", ctes=DT_DEV, sql="""
SELECT device, ts_us // 604800000000 AS wk, sum(CASE WHEN w > 40 THEN least(dt, 1800) ELSE 0 END) / sum(least(dt, 1800)) AS duty,
 avg(CASE WHEN w BETWEEN 100 AND 200 THEN 1.0 ELSE 0.0 END) AS band_share FROM g WHERE dt IS NOT NULL GROUP BY 1, 2""")
def a19(t):
    g = X.gaps(t.devices, ["device"]).withColumn("c", F.least("dt_s", F.lit(1800.0)))
    return g.groupBy("device", bucket_of("ts_us", 7 * DAY_US).alias("wk")).agg(
        (F.sum(F.when(F.col("w") > 40, F.col("c")).otherwise(0.0)) / F.sum("c")).alias("duty"), F.avg(F.col("w").between(100, 200).cast("int")).alias("band_share"))


@query("a20_simultaneity", "house:i k:i n:i share:d", views="channels", sql="""
WITH s AS (SELECT house, min(ts_us) AS t0, max(ts_us) AS t1 FROM channels GROUP BY house),
c AS (SELECT c.house, device, (ts_us - t0) // 7200000000 AS b, avg(CASE WHEN w > 30 THEN 1.0 ELSE 0.0 END) AS m FROM channels c JOIN s ON c.house = s.house GROUP BY 1, 2, 3),
grid AS (SELECT house, unnest(generate_series(0, (t1 - t0) // 7200000000)) AS b FROM s),
k AS (SELECT grid.house, grid.b, count(device) AS k FROM grid LEFT JOIN (SELECT * FROM c WHERE m > 0.5) c ON grid.house = c.house AND grid.b = c.b GROUP BY 1, 2)
SELECT house, k, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY house) AS share FROM k GROUP BY house, k""")
def a20(t):
    return RS.simultaneity(t.channels, ["house"], "device", F.col("w") > 30, 7200)


@query("a22_switch_multiplicity", "k:i n:i", sql="""
SELECT k, count(*) AS n FROM (SELECT epoch_us(ts) // 60000000 AS m, count(*) AS k FROM events WHERE value > 30 GROUP BY 1) GROUP BY k""")
def a22(t):
    return t.mains.where("w > 30").groupBy(bucket_of("ts_us", 60_000_000).alias("m")).agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


COV = """
cv AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS hr, sum(value) AS total, sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) AS labelled FROM events GROUP BY 1, 2)"""


@query("a23_coverage", "house:i coverage:d r:d resid_mean:d resid_p50:d resid_p95:d neg_share:d night_over_day:d", ctes=COV, sql="""
SELECT house, sum(labelled) / sum(total) AS coverage, corr(total, labelled) AS r, avg(total - labelled) AS resid_mean, quantile_cont(total - labelled, 0.5) AS resid_p50,
 quantile_cont(total - labelled, 0.95) AS resid_p95, avg(CASE WHEN total - labelled < 0 THEN 1.0 ELSE 0.0 END) AS neg_share,
 avg(CASE WHEN hr % 24 < 6 THEN total - labelled END) / avg(CASE WHEN hr % 24 >= 6 THEN total - labelled END) AS night_over_day FROM cv GROUP BY house""")
def a23(t):
    lab = F.when(F.col("device") != "error", F.col("w")).otherwise(0.0)
    c = t.channels.groupBy("house", bucket_of("ts_us", H).alias("hr")).agg(F.sum("w").alias("total"), F.sum(lab).alias("labelled"))
    c = c.withColumn("resid", F.col("total") - F.col("labelled"))
    night = F.col("hr") % 24 < 6
    a = c.groupBy("house").agg((F.sum("labelled") / F.sum("total")).alias("coverage"), F.corr("total", "labelled").alias("r"), F.avg("resid").alias("resid_mean"),
                               F.avg((F.col("resid") < 0).cast("int")).alias("neg_share"), (F.avg(F.when(night, F.col("resid"))) / F.avg(F.when(~night, F.col("resid")))).alias("night_over_day"))
    return a.join(exact_quantiles(c, ["house"], {"resid_p50": ("resid", 0.5), "resid_p95": ("resid", 0.95)}), "house")


@query("a24_coverage_over_time", "frac:d1 n:i coverage:d", sql="""
WITH s AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM events),
f AS (SELECT frac, t0 + CAST(floor(frac * (t1 - t0)) AS BIGINT) AS a FROM s, (VALUES (0.0), (0.2), (0.4), (0.6), (0.8)) v(frac))
SELECT frac, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) / sum(value) AS coverage FROM f JOIN events e ON epoch_us(e.ts) >= a AND epoch_us(e.ts) < a + 432000000000 GROUP BY frac""")
def a24(t):
    """Five-day windows at fractions of the span; five window rows meet the stream."""
    s = t.devices.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    f = s.select(F.explode(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6, 0.8)])).alias("frac"), "t0", "t1")
    f = f.select("frac", (F.col("t0") + F.floor(F.col("frac") * (F.col("t1") - F.col("t0")))).alias("a"))
    d = t.devices.join(F.broadcast(f), (F.col("ts_us") >= F.col("a")) & (F.col("ts_us") < F.col("a") + 5 * DAY_US))
    return d.groupBy("frac").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("device") != "error", F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))


@query("a25_honest_days", "house:i n_days:i n_honest:i kwh:d peak_day:i typical_day:i", views="mains", sql="""
WITH d AS (SELECT house, ts_us // 86400000000 AS day, count(*) AS n, sum(w) / 1000 AS e FROM mains GROUP BY 1, 2),
h AS (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY house) AS md FROM d WHERE n >= 60)
SELECT h.house, any_value(t.n_days) AS n_days, count(*) AS n_honest, sum(e) AS kwh, max_by(day, (e, -day)) AS peak_day, min_by(day, (abs(e - md), day)) AS typical_day
FROM h JOIN (SELECT house, count(*) AS n_days FROM d GROUP BY house) t ON h.house = t.house GROUP BY h.house""")
def a25(t):
    d = t.mains.groupBy("house", bucket_of("ts_us", DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.sum("w") / 1000).alias("e"))
    n = d.groupBy("house").agg(F.count(F.lit(1)).alias("n_days"))
    h = d.where("n >= 60").withColumn("md", F.percentile("e", 0.5).over(W.partitionBy("house")))  # one row a day
    return h.groupBy("house").agg(F.count(F.lit(1)).alias("n_honest"), F.sum("e").alias("kwh"), F.max_by("day", F.struct("e", -F.col("day"))).alias("peak_day"),
                                  F.min_by("day", F.struct(F.abs(F.col("e") - F.col("md")), F.col("day"))).alias("typical_day")).join(n, "house")


@query("a26_nested_attribution", "house:i all_wh:d top_wh:d nested_share:d", views="channels", sql="""
SELECT house, sum(w) AS all_wh, sum(CASE WHEN nested = 0 THEN w ELSE 0 END) AS top_wh, sum(CASE WHEN nested = 1 THEN w ELSE 0 END) / sum(w) AS nested_share
FROM channels c JOIN (VALUES ('click', 0), ('view', 0), ('signup', 0), ('error', 1), ('purchase', 1)) n(device, nested) ON c.device = n.device GROUP BY house""")
def a26(t):
    dim = t.spark.createDataFrame([("click", 0), ("view", 0), ("signup", 0), ("error", 1), ("purchase", 1)], "device string, nested int")
    d = t.channels.join(F.broadcast(dim), "device")  # five literal rows
    return d.groupBy("house").agg(F.sum("w").alias("all_wh"), F.sum(F.when(F.col("nested") == 0, F.col("w")).otherwise(0.0)).alias("top_wh"),
                                  (F.sum(F.when(F.col("nested") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("nested_share"))


@query("a27_nesting_test", "house:i r:d mean_abs:d p99_abs:d", ctes=COV, sql="""
SELECT house, corr(total, labelled) AS r, avg(abs(total - labelled)) AS mean_abs, quantile_cont(abs(total - labelled), 0.99) AS p99_abs FROM cv GROUP BY house""")
def a27(t):
    """Parent meter against the sum of its children per bucket."""
    b = bucket_of("ts_us", H).alias("hr")
    parent = t.mains.groupBy("house", b).agg(F.sum("w").alias("p"))
    kids = t.channels.where("device <> 'error'").groupBy("house", b).agg(F.sum("w").alias("c"))
    j = parent.join(kids, ["house", "hr"], "left").withColumn("c", F.coalesce("c", F.lit(0.0))).withColumn("d", F.abs(F.col("p") - F.col("c")))
    return j.groupBy("house").agg(F.corr("p", "c").alias("r"), F.avg("d").alias("mean_abs")).join(exact_quantiles(j, ["house"], {"p99_abs": ("d", 0.99)}), "house")


@query("a28_tiling_residual", "house:i max_abs:d n:i", views="mains channels", sql="""
WITH a AS (SELECT house, ts_us // 3600000000 AS hr, sum(w) AS t FROM mains GROUP BY 1, 2),
b AS (SELECT house, ts_us // 3600000000 AS hr, sum(CASE WHEN device IN ('click', 'view') THEN w ELSE 0 END) + sum(CASE WHEN device NOT IN ('click', 'view') THEN w ELSE 0 END) AS p FROM channels GROUP BY 1, 2)
SELECT a.house, max(abs(t - p)) AS max_abs, count(*) AS n FROM a JOIN b ON a.house = b.house AND a.hr = b.hr GROUP BY a.house""")
def a28(t):
    b = bucket_of("ts_us", H).alias("hr")
    tot = t.mains.groupBy("house", b).agg(F.sum("w").alias("t"))
    two = F.col("device").isin("click", "view")
    parts = t.channels.groupBy("house", b).agg((F.sum(F.when(two, F.col("w")).otherwise(0.0)) + F.sum(F.when(~two, F.col("w")).otherwise(0.0))).alias("p"))
    return tot.join(parts, ["house", "hr"]).groupBy("house").agg(F.max(F.abs(F.col("t") - F.col("p"))).alias("max_abs"), F.count(F.lit(1)).alias("n"))


@query("a29_physics_violation", "l_suppkey:i violation_share:d burst_ratio_p50:d sum_p:d1 sum_s:d1", sql="""
WITH x AS (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS p, l_extendedprice * (1 - l_tax) AS s FROM lineitem)
SELECT l_suppkey, avg(CASE WHEN s < p THEN 1.0 ELSE 0.0 END) AS violation_share, quantile_cont(CASE WHEN p > 60000 THEN p / s END, 0.5) AS burst_ratio_p50, sum(p) AS sum_p, sum(s) AS sum_s FROM x GROUP BY l_suppkey""")
def a29(t):
    x = t.lineitem.select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("s"))
    x = x.withColumn("ratio", F.when(F.col("p") > 60000, F.col("p") / F.col("s")))
    a = x.groupBy("l_suppkey").agg(F.avg((F.col("s") < F.col("p")).cast("int")).alias("violation_share"), F.sum("p").alias("sum_p"), F.sum("s").alias("sum_s"))
    return a.join(exact_quantiles(x, ["l_suppkey"], {"burst_ratio_p50": ("ratio", 0.5)}), "l_suppkey", "left")


@query("a30_enrichment", "house:i p_given:d p_base:d lift:d hour_matched:d", sql="""
WITH m AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS hr, max(CASE WHEN event_type = 'view' AND value > 40 THEN 1 ELSE 0 END) AS flow,
  max(CASE WHEN event_type = 'click' AND value > 40 THEN 1 ELSE 0 END) AS burst FROM events GROUP BY 1, 2),
h AS (SELECT house, hr % 24 AS hod, avg(flow) AS pf FROM m GROUP BY 1, 2)
SELECT m.house, avg(CASE WHEN burst = 1 THEN flow END) AS p_given, avg(flow) AS p_base, avg(CASE WHEN burst = 1 THEN flow END) / avg(flow) AS lift,
 avg(CASE WHEN burst = 1 THEN pf END) AS hour_matched FROM m JOIN h ON m.house = h.house AND m.hr % 24 = h.hod GROUP BY m.house""")
def a30(t):
    big = lambda d: ((F.col("device") == d) & (F.col("w") > 40)).cast("int")
    m = t.channels.groupBy("house", bucket_of("ts_us", H).alias("hr")).agg(F.max(big("view")).alias("flow"), F.max(big("click")).alias("burst"))
    m = m.withColumn("hod", F.col("hr") % 24)
    m = m.withColumn("pf", F.avg("flow").over(W.partitionBy("house", "hod")))
    b = F.col("burst") == 1
    g = m.groupBy("house").agg(F.avg(F.when(b, F.col("flow"))).alias("p_given"), F.avg("flow").alias("p_base"), F.avg(F.when(b, F.col("pf"))).alias("hour_matched"))
    return g.withColumn("lift", F.col("p_given") / F.col("p_base"))


REG = "reg AS (SELECT user_id AS meter, epoch_us(ts) AS ts_us, event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def register(t):
    return t.events.select(F.col("user_id").alias("meter"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"),
                           F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


@query("a31_register_audit", "meter:i n_neg:i naive_sum:i span:i n_groups:i", ctes=REG, sql="""
WITH a AS (SELECT *, k - lag(k) OVER o AS d, row_number() OVER o - 1 AS i FROM reg WINDOW o AS (PARTITION BY meter ORDER BY ts_us, seq)),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY meter ORDER BY i) <= 2 THEN 0 ELSE 1 END AS brk FROM a WHERE d < 0),
g AS (SELECT meter, sum(brk) AS n_groups FROM n GROUP BY meter)
SELECT a.meter, count(*) FILTER (d < 0) AS n_neg, sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS naive_sum, max_by(k, i) - min_by(k, i) AS span, coalesce(any_value(g.n_groups), 0) AS n_groups
FROM a LEFT JOIN g ON a.meter = g.meter GROUP BY a.meter""")
def a31(t):
    a = ordered_scan(register(t), ["meter"], ["ts_us", "seq"], bucket_of("ts_us", CH), lag={"pk": "k"}, row_number="i").withColumn("d", F.col("k") - F.col("pk"))
    neg = a.where("d < 0")
    grp = islands(neg, ["meter"], ["i"], bucket_of("i", 1 << 18), row={"i": "i"}, breaks=lambda p, c: c["i"] - p["i"] > 2).groupBy("meter").agg(F.count(F.lit(1)).alias("n_groups"))
    s = a.groupBy("meter").agg(F.count_if(F.col("d") < 0).alias("n_neg"), F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).alias("naive_sum"),
                               (F.max_by("k", "i") - F.min_by("k", "i")).alias("span"))
    return s.join(grp, "meter", "left").fillna(0, ["n_groups"])


@query("a31_register_integral", "meter:i span:i naive_ratio:d integral:d gap_share:d", ctes=REG + ", rd AS (SELECT user_id AS meter, epoch_us(ts) AS ts_us, event_id AS seq, value AS w FROM events)", sql="""
WITH a AS (SELECT *, k - lag(k) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS d, row_number() OVER (PARTITION BY meter ORDER BY ts_us, seq) AS i FROM reg),
s AS (SELECT meter, max_by(k, i) - min_by(k, i) AS span, sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS naive FROM a GROUP BY meter),
e AS (SELECT meter, sum(w * least(coalesce(nx - ts_us, 0), 3600000000)) / 3.6e9 AS wh FROM (SELECT *, lead(ts_us) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS nx FROM rd) GROUP BY meter)
SELECT s.meter, span, naive / nullif(span, 0) AS naive_ratio, coalesce(wh, 0) AS integral, abs(span - coalesce(wh, 0)) / nullif(abs(span), 0) AS gap_share FROM s JOIN e ON s.meter = e.meter""")
def a31_integral(t):
    """What the register says (its span, and the sum of its rises) beside the integral of the power."""
    return ST.register_integral(register(t), t.readings, ["meter"], max_hold_s=3600, chunk_us=CH)


@query("a31_wrap_sizes", "meter:i unit:i n_drops:i n_wraps:i largest:i", ctes=REG, sql="""
WITH d AS (SELECT meter, -(k - lag(k) OVER (PARTITION BY meter ORDER BY ts_us, seq)) AS drop FROM reg),
b AS (SELECT meter, drop FROM d WHERE drop >= 20), u AS (SELECT meter, min(drop) AS unit FROM b GROUP BY meter)
SELECT b.meter, unit, count(*) AS n_drops, count(*) FILTER (drop % unit = 0) AS n_wraps, max(drop) AS largest FROM b JOIN u ON b.meter = u.meter GROUP BY b.meter, unit""")
def a31_wraps(t):
    """Large drops, and how many are multiples of the smallest: the mark of a counter that wraps."""
    return ST.wrap_sizes(register(t), ["meter"], least=20, chunk_us=CH)


@query("a32_electrical_identities", "va_err:d wh_err:d pf_mean:d", sql="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_extendedprice / l_quantity AS i, l_extendedprice AS va, l_extendedprice * (1 - l_discount) AS w FROM lineitem)
SELECT max(abs(va - v * i)) AS va_err, max(abs(w - va * (w / va))) AS wh_err, avg(w / va) AS pf_mean FROM x""")
def a32(t):
    va, w = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    i = va / F.col("l_quantity")
    return t.lineitem.agg(F.max(F.abs(va - F.col("l_quantity") * i)).alias("va_err"), F.max(F.abs(w - va * (w / va))).alias("wh_err"), F.avg(w / va).alias("pf_mean"))


@query("a33_circuit_ratios", "l_suppkey:i ratio_p50:d tax_on_p50:d drop_mean:d", sql="""
WITH x AS (SELECT *, lag(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS pd,
  lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS pq FROM lineitem)
SELECT l_suppkey, quantile_cont(CASE WHEN l_quantity > 10 THEN l_extendedprice / l_quantity END, 0.5) AS ratio_p50, quantile_cont(CASE WHEN l_quantity > 10 THEN l_tax END, 0.5) AS tax_on_p50,
 avg(CASE WHEN l_quantity > 10 AND pq <= 10 THEN l_discount - pd END) AS drop_mean FROM x GROUP BY l_suppkey""")
def a33(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # one lag of both values, years as chunks: a supplier's rows of a month are few, and summaries as many as rows cost as much
    both = F.struct(F.col("l_discount").alias("pd"), F.col("l_quantity").alias("pq"))
    x = ordered_scan(t.lineitem.select("l_suppkey", *order), ["l_suppkey"], order, F.year("l_shipdate"), lag={"p": both})
    on = F.col("l_quantity") > 10
    x = x.select("l_suppkey", F.when(on, F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"), F.when(on, F.col("l_tax")).alias("tax"),
                 F.when(on & (F.col("p.pq") <= 10), F.col("l_discount") - F.col("p.pd")).alias("drop"))
    li = t.lineitem.where(on)
    q = exact_quantiles(li.select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"), F.col("l_tax").alias("tax")), ["l_suppkey"],
                        {"ratio_p50": ("ratio", 0.5), "tax_on_p50": ("tax", 0.5)}, per_octave=1)
    return x.groupBy("l_suppkey").agg(F.avg("drop").alias("drop_mean")).join(q, "l_suppkey", "left")


@query("a34_phase_residual", "house:i max_abs:d mean_abs:d", sql="""
SELECT user_id % 5 AS house, max(abs(value - (value * 0.5) * 2 * cos(radians(event_id % 60)))) AS max_abs, avg(abs(value - (value * 0.5) * 2 * cos(radians(event_id % 60)))) AS mean_abs FROM events GROUP BY 1""")
def a34(t):
    r = F.abs(F.col("w") - (F.col("w") * 0.5) * 2 * F.cos(F.radians(F.col("seq") % 60)))
    return t.mains.groupBy("house").agg(F.max(r).alias("max_abs"), F.avg(r).alias("mean_abs"))


PSI_EDGES = ", ".join(f"quantile_cont(w, {i / 10}) AS e{i}" for i in range(1, 10))
PSI_BIN = " + ".join(f"CASE WHEN w >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
PSI_SQL = f"""
WITH n AS (SELECT user_id % 5 AS house, value AS w FROM events WHERE ts >= TIMESTAMP '2024-01-16'), r AS (SELECT user_id % 5 AS house, value AS w FROM events WHERE ts < TIMESTAMP '2024-01-16'),
e AS (SELECT house, {PSI_EDGES} FROM r GROUP BY house),
cn AS (SELECT n.house, {PSI_BIN} AS b, count(*) AS c FROM n JOIN e ON n.house = e.house GROUP BY 1, 2),
cr AS (SELECT r.house, {PSI_BIN} AS b, count(*) AS c FROM r JOIN e ON r.house = e.house GROUP BY 1, 2),
s AS (SELECT e.house, b.b, coalesce(cn.c, 0) AS cn, coalesce(cr.c, 0) AS cr FROM e CROSS JOIN range(10) b(b) LEFT JOIN cn ON cn.house = e.house AND cn.b = b.b LEFT JOIN cr ON cr.house = e.house AND cr.b = b.b),
p AS (SELECT house, greatest(cn / sum(cn) OVER (PARTITION BY house), 1e-6) AS pn, greatest(cr / sum(cr) OVER (PARTITION BY house), 1e-6) AS pr FROM s)
"""


def split_halves(t):
    cut = 1705363200000000
    return t.mains.where(F.col("ts_us") >= cut), t.mains.where(F.col("ts_us") < cut)


@query("a35_psi", "house:i psi:d", PSI_SQL + "SELECT house, sum((pn - pr) * ln(pn / pr)) AS psi FROM p GROUP BY house")
def a35(t):
    new, ref = split_halves(t)
    return ST.psi(new, ref, ["house"])


@query("a36_shift_verdicts", "house:i metric:s ratio:d verdict:s", PSI_SQL.rstrip() + """,
m AS (SELECT n.house, 'mean_w' AS metric, n.v / r.v AS ratio, 0.95 AS lo, 1.05 AS hi FROM (SELECT house, avg(w) AS v FROM n GROUP BY house) n JOIN (SELECT house, avg(w) AS v FROM r GROUP BY house) r ON n.house = r.house
 UNION ALL SELECT n.house, 'p95_w', n.v / r.v, 0.98, 1.02 FROM (SELECT house, quantile_cont(w, 0.95) AS v FROM n GROUP BY house) n JOIN (SELECT house, quantile_cont(w, 0.95) AS v FROM r GROUP BY house) r ON n.house = r.house)
SELECT house, metric, ratio, CASE WHEN ratio BETWEEN lo AND hi THEN 'PASS' ELSE 'FLAG' END AS verdict FROM m
UNION ALL SELECT house, 'psi', v, CASE WHEN v < 0.1 THEN 'PASS' WHEN v < 0.25 THEN 'MODERATE' ELSE 'FLAG' END FROM (SELECT house, sum((pn - pr) * ln(pn / pr)) AS v FROM p GROUP BY house)""")
def a36(t):
    new, ref = split_halves(t)

    def metrics(d):
        a = d.groupBy("house").agg(F.avg("w").alias("mean_w")).join(exact_quantiles(d, ["house"], {"p95_w": ("w", 0.95)}), "house")
        return a.unpivot(["house"], ["mean_w", "p95_w"], "metric", "v")

    bands = t.spark.createDataFrame([("mean_w", 0.95, 1.05), ("p95_w", 0.98, 1.02)], "metric string, lo double, hi double")
    m = metrics(new).join(metrics(ref).withColumnRenamed("v", "rv"), ["house", "metric"]).join(F.broadcast(bands), "metric")
    m = m.select("house", "metric", (F.col("v") / F.col("rv")).alias("ratio"), ST.band_verdict(F.col("v") / F.col("rv"), F.col("lo"), F.col("hi")).alias("verdict"))
    p = ST.psi(new, ref, ["house"]).select("house", F.lit("psi").alias("metric"), F.col("psi").alias("ratio"), ST.psi_verdict(F.col("psi")).alias("verdict"))
    return m.unionByName(p)


@query("a37_moments", "device:s n:i n_distinct:i skew:d kurt:d", views="devices", sql="""
SELECT device, count(w) AS n, count(DISTINCT w) AS n_distinct, skewness(w) AS skew, kurtosis(w) AS kurt FROM devices GROUP BY device""")
def a37(t):
    return ST.sample_moments(t.devices, ["device"])


@query("a38_level_by_active", "n_on:i n:i mean_w:d sd_w:d min_w:d max_w:d", sql="""
WITH b AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS hr, count(DISTINCT CASE WHEN value > 30 THEN event_type END) AS n_on, avg(value) AS w FROM events GROUP BY 1, 2)
SELECT n_on, count(*) AS n, avg(w) AS mean_w, stddev_samp(w) AS sd_w, min(w) AS min_w, max(w) AS max_w FROM b GROUP BY n_on""")
def a38(t):
    c = t.channels.groupBy("house", bucket_of("ts_us", H).alias("hr"), "device").agg(F.max((F.col("w") > 30).cast("int")).alias("on"), F.sum("w").alias("s"), F.count("w").alias("c"))
    b = c.groupBy("house", "hr").agg(F.sum("on").alias("n_on"), (F.sum("s") / F.sum("c")).alias("w"))
    return b.groupBy("n_on").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"), F.stddev_samp("w").alias("sd_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))
