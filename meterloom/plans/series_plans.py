"""Queries on runs, episodes, gaps, windows (order-dependent operators)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import energy as E
from ..operators import episodes as X
from ..operators.joins import last_before
from ..operators.ordered import DAY_US, bucket_of, ordered_scan
from ..operators.quantiles import exact_quantiles, with_quantiles
from .catalog import Tables, query

H = 3_600_000_000
CH = 2 * DAY_US  # chunk of the sparse test stream; one day for real meters

# ON runs of a channel and the episode rule as SQL, shared by several oracles
THR, MERGE_S, DWELL_S, HOLD_S = 30.0, 21600.0, 3600.0, 7200.0


def runs_sql(src: str, keys: str, on: str, hold_s: float = HOLD_S, name: str = "runs") -> str:
    """ON runs by row adjacency with hold energy."""
    return f"""
{name}_a AS (SELECT *, CASE WHEN {on} THEN 1 ELSE 0 END AS st,
   lead(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us, seq) AS nx FROM {src}),
{name}_b AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY {keys} ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk,
   w * least(coalesce(nx - ts_us, 0), {int(hold_s * 1e6)}) / 3.6e9 AS e FROM {name}_a),
{name}_c AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY ts_us, seq) AS rid FROM {name}_b),
{name} AS (SELECT {keys}, rid, min(st) AS state, min(ts_us) AS t_on_us, max(ts_us) AS t_off_us, count(*) AS n_rows,
   sum(e) AS energy_wh FROM {name}_c GROUP BY {keys}, rid)"""


def episodes_sql(src: str, keys: str, on: str, *, merge_s: float = MERGE_S, dwell_s: float = DWELL_S,
                 hold_s: float = HOLD_S, name: str = "ep") -> str:
    return runs_sql(src, keys, on, hold_s, name + "_r") + f""",
{name}_on AS (SELECT *, CASE WHEN t_on_us - lag(t_off_us) OVER (PARTITION BY {keys} ORDER BY t_on_us) <= {int(merge_s * 1e6)}
   THEN 0 ELSE 1 END AS brk2 FROM {name}_r WHERE state = 1),
{name}_id AS (SELECT *, sum(brk2) OVER (PARTITION BY {keys} ORDER BY t_on_us) AS eid FROM {name}_on),
{name} AS (SELECT {keys}, min(t_on_us) AS t_on_us, max(t_off_us) AS t_off_us, (max(t_off_us) - min(t_on_us)) / 1e6 AS dur_s,
   sum(energy_wh) AS energy_wh, sum(n_rows) AS n_rows, count(*) AS n_merged
   FROM {name}_id GROUP BY {keys}, eid HAVING (max(t_off_us) - min(t_on_us)) / 1e6 >= {dwell_s})"""


def channel_episodes(t: Tables, thr=THR, merge_s=MERGE_S, dwell_s=DWELL_S):
    return X.build_episodes(t.channels, ["house", "device"], thr, min_dwell_s=dwell_s, merge_gap_s=merge_s,
                            max_hold_s=HOLD_S, chunk_us=CH)


CHANNEL_EP = episodes_sql("channels", "house, device", f"w > {THR}")


@query("w01_run_lengths", "house:i device:s state:i t_on_us:i t_off_us:i n_rows:i", views="channels",
       ctes=runs_sql("channels", "house, device", f"w > {THR}"), sql="SELECT * FROM runs")
def w01(t):
    return X.state_runs(t.channels, ["house", "device"], X.on_mark(F.col("w") > THR), chunk_us=CH, hold_s=HOLD_S)


@query("w02_episodes", "house:i device:s t_on_us:i t_off_us:i dur_s:d energy_wh:d n_merged:i", views="channels",
       ctes=CHANNEL_EP, sql="SELECT * FROM ep")
def w02(t):
    return channel_episodes(t)


@query("w02_episodes_hot_meter", "device:s t_on_us:i t_off_us:i dur_s:d energy_wh:d n_rows:i", views="devices",
       ctes=episodes_sql("devices", "device", "w > 60", merge_s=1800, dwell_s=600, hold_s=3600), sql="SELECT * FROM ep")
def w02_hot(t):
    return X.build_episodes(t.devices, ["device"], 60.0, min_dwell_s=600, merge_gap_s=1800, max_hold_s=3600)


@query("w02_episodes_gap_cut", "house:i device:s t_on_us:i t_off_us:i n_rows:i", views="channels", sql="""
WITH a AS (SELECT *, CASE WHEN w > 30 THEN 1 ELSE 0 END AS st FROM channels),
b AS (SELECT *, CASE WHEN st = lag(st) OVER o AND ts_us - lag(ts_us) OVER o <= 7200000000 THEN 0 ELSE 1 END AS brk
  FROM a WINDOW o AS (PARTITION BY house, device ORDER BY ts_us, seq)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY house, device ORDER BY ts_us, seq) AS rid FROM b)
SELECT house, device, min(ts_us) AS t_on_us, max(ts_us) AS t_off_us, count(*) AS n_rows FROM c WHERE st = 1
GROUP BY house, device, rid""")
def w02_gap(t):
    """The option that lets an outage break a run."""
    return X.state_runs(t.channels, ["house", "device"], X.on_mark(F.col("w") > THR), chunk_us=CH,
                        max_gap_s=7200).where("state = 1")


HYST = """
{n}_a AS (SELECT *, CASE WHEN {up} THEN 1 WHEN {down} THEN 0 END AS mk FROM {src}),
{n}_b AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts_us, seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_state FROM {n}_a)"""


def hyst_sql(src, keys, up, down, n="hy"):
    return HYST.format(n=n, src=src, k=keys, up=up, down=down)


@query("w06_anchor_episodes", "house:i t_on_us:i t_off_us:i dur_s:d energy_wh:d", views="mains",
       ctes=hyst_sql("mains", "house", "w > 60", "w < 54") + ","
       + episodes_sql("hy_b", "house", "on_state = 1", merge_s=900, dwell_s=600, hold_s=1800), sql="SELECT * FROM ep")
def w06(t):
    return X.anchor_episodes(t.mains, ["house"], 60.0, min_dwell_s=600, merge_gap_s=900, hold_s=1800)


@query("w07_hysteresis_samples", "house:i i_on:i n_samples:i t_on_us:i t_off_us:i", views="mains",
       ctes=hyst_sql("mains", "house", "w >= 50", "w <= 25"), sql="""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) - 1 AS i,
   CASE WHEN on_state = lag(on_state) OVER (PARTITION BY house ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM hy_b),
b AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us, seq) AS rid FROM a)
SELECT house, min(i) AS i_on, count(*) AS n_samples, min(ts_us) AS t_on_us, max(ts_us) AS t_off_us
FROM b WHERE on_state = 1 GROUP BY house, rid HAVING count(*) >= 2""")
def w07(t):
    return X.detect_samples(t.mains, ["house"], 50.0, 25.0, min_samples=2)


@query("w04_merge_in_samples", "house:i i_on:i n_samples:i", views="mains",
       ctes=hyst_sql("mains", "house", "w >= 50", "w <= 25"), sql="""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) - 1 AS i,
   CASE WHEN on_state = lag(on_state) OVER (PARTITION BY house ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM hy_b),
b AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us, seq) AS rid FROM a),
c AS (SELECT house, min(i) AS s, max(i) + 1 AS e FROM b WHERE on_state = 1 GROUP BY house, rid HAVING count(*) >= 2),
d AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY house ORDER BY s) <= 3 THEN 0 ELSE 1 END AS brk FROM c),
f AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY s) AS g FROM d)
SELECT house, min(s) AS i_on, max(e) - min(s) AS n_samples FROM f GROUP BY house, g""")
def w04(t):
    return X.detect_samples(t.mains, ["house"], 50.0, 25.0, min_samples=2, merge_samples=3)


@query("w03_merge_split_veto", "house:i t_on_us:i t_off_us:i dur_s:d", views="mains", sql="""
WITH a AS (SELECT *, CASE WHEN w > 30 AND w <= 150 THEN 1 ELSE 0 END AS st, CASE WHEN w > 150 THEN 1 ELSE 0 END AS g FROM mains),
b AS (SELECT *, sum(g) OVER o AS gc, CASE WHEN st = lag(st) OVER o THEN 0 ELSE 1 END AS brk FROM a
  WINDOW o AS (PARTITION BY house ORDER BY ts_us, seq)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us, seq) AS rid FROM b),
d AS (SELECT house, min(ts_us) AS s, max(ts_us) AS e, min(gc) AS g0, max(gc) AS g1 FROM c WHERE st = 1 GROUP BY house, rid),
f AS (SELECT *, CASE WHEN s - lag(e) OVER o <= 1800000000 AND g0 - lag(g1) OVER o < 1 THEN 0 ELSE 1 END AS brk FROM d
  WINDOW o AS (PARTITION BY house ORDER BY s)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY s) AS gid FROM f)
SELECT house, min(s) AS t_on_us, max(e) AS t_off_us, (max(e) - min(s)) / 1e6 AS dur_s FROM g GROUP BY house, gid
HAVING (max(e) - min(s)) / 1e6 >= 600""")
def w03(t):
    """Claimed 30-150 W; a gap with one gated (> 150 W) row never merges."""
    w = F.col("w")
    return X.gated_episodes(t.mains, ["house"], (w > 30) & (w <= 150), F.coalesce(w > 150, F.lit(False)),
                            merge_gap_s=1800, min_dwell_s=600, gate_split_rows=1)


@query("w05_gap_tolerant_runs", "meter:i n_episodes:i dwell_p50_rows:d", views="readings", sql="""
WITH a AS (SELECT *, CASE WHEN w > 20 THEN 1 ELSE 0 END AS st,
  row_number() OVER (PARTITION BY meter ORDER BY ts_us, seq) - 1 AS i FROM readings),
b AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY meter ORDER BY i) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY meter ORDER BY i) AS rid FROM b),
d AS (SELECT meter, min(i) AS s, max(i) + 1 AS e FROM c WHERE st = 1 GROUP BY meter, rid),
f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY meter ORDER BY s) <= 2 THEN 0 ELSE 1 END AS brk FROM d),
g AS (SELECT *, sum(brk) OVER (PARTITION BY meter ORDER BY s) AS gid FROM f),
h AS (SELECT meter, gid, max(e) - min(s) AS n FROM g GROUP BY meter, gid)
SELECT meter, count(*) AS n_episodes, quantile_cont(n, 0.5) AS dwell_p50_rows FROM h GROUP BY meter""")
def w05(t):
    ep = X.sample_episodes(t.readings, ["meter"], F.col("w") > 20, gap_samples=2, chunk_us=CH)
    return exact_quantiles(ep, ["meter"], {"dwell_p50_rows": ("n_samples", 0.5)}, {"n_episodes": "n_samples"})


W08_SQL = """
WITH a AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY house) AS n,
  CASE WHEN count(w) OVER f >= 3 THEN avg(w) OVER f END AS sm FROM mains
  WINDOW o AS (PARTITION BY house ORDER BY ts_us, seq), f AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, coalesce(sm > 60, false) AS ab, coalesce(sm < 45, false) AS be FROM a),
c AS (SELECT *, lag(ab) OVER o AS pab, be AND (coalesce(lead(be, 1) OVER o, false) AND coalesce(lead(be, 2) OVER o, false) OR i >= n - 3) AS en,
  coalesce(lead(ts_us) OVER o, ts_us) AS aft FROM b WINDOW o AS (PARTITION BY house ORDER BY i)),
e AS (SELECT house, ts_us, i, aft FROM c WHERE en),
s AS (SELECT house, ts_us AS t0, i AS i0 FROM c WHERE ab AND pab = false),
r AS (SELECT s.house, t0, i0, min_by(e.aft, e.i) AS t1 FROM s JOIN e ON s.house = e.house AND e.i >= s.i0 GROUP BY s.house, t0, i0),
p AS (SELECT r.house, t0, t1, max(c.sm) AS peak FROM r JOIN c ON r.house = c.house AND c.ts_us BETWEEN t0 AND t1 GROUP BY r.house, t0, t1),
q AS (SELECT r.house, t0, quantile_cont(m.w, 0.5) AS base FROM r JOIN mains m ON r.house = m.house AND m.ts_us >= t0 - 10800000000 AND m.ts_us < t0 GROUP BY r.house, t0)
SELECT p.house, p.t0 AS t0_us, p.t1 AS t1_us, peak - base AS dp_w, (p.t1 - p.t0) / 1e6 AS dur_s FROM p LEFT JOIN q ON p.house = q.house AND p.t0 = q.t0"""


@query("w08_activation_runs", "house:i t0_us:i t1_us:i dp_w:d dur_s:d", W08_SQL, views="mains")
def w08(t):
    return X.activation_runs(t.mains, ["house"], on_w=60, off_w=45, base_s=10800, rows_per_chunk=512)


@query("w09_release_runs", "house:i t0_us:i t1_us:i peak:d n_steps:i", views="mains", sql="""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) - 1 AS i FROM mains),
b AS (SELECT *, lag(ts_us, 2) OVER o AS ts2, CASE WHEN w >= 100 THEN 1 WHEN w < 40 AND coalesce(lag(w, 1) OVER o < 40, false)
   AND coalesce(lag(w, 2) OVER o < 40, false) THEN 0 END AS mk FROM a WINDOW o AS (PARTITION BY house ORDER BY i)),
c AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY house ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM b),
d AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY house ORDER BY i) THEN 0 ELSE 1 END AS brk, max(i) OVER (PARTITION BY house) AS mi FROM c),
e AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY i) AS rid FROM d)
SELECT house, min(ts_us) AS t0_us, CASE WHEN max(i) = any_value(mi) THEN max(ts_us) ELSE max_by(ts2, i) END AS t1_us, max(w) AS peak,
  CASE WHEN max(i) = any_value(mi) THEN max(i) ELSE max(i) - 2 END - min(i) AS n_steps FROM e WHERE st = 1 GROUP BY house, rid""")
def w09(t):
    return X.release_runs(t.mains, ["house"], on_w=100, off_w=40, rows_per_chunk=512)


@query("w10_rising_edges", "house:i ts_us:i w:d", views="mains", sql="""
SELECT house, ts_us, w FROM (SELECT *, lag(w) OVER (PARTITION BY house ORDER BY ts_us, seq) AS p FROM mains)
WHERE w > 80 AND NOT coalesce(p > 80, false)""")
def w10(t):
    d = X.with_previous(t.mains, ["house"], ["w"])
    return X.rising_edges(d, F.col("w"), F.col("prev_w"), 80.0)


STEP_SQL = """
WITH a AS (SELECT *, CASE WHEN count(w) OVER f = 3 AND count(w) OVER b = 3 THEN avg(w) OVER f - avg(w) OVER b END AS step
  FROM mains WINDOW f AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
  b AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, lag(step) OVER (PARTITION BY house ORDER BY ts_us, seq) AS prev FROM a)"""


@query("w12_step_signal", "house:i ts_us:i step:d", views="mains", sql=STEP_SQL + "SELECT house, ts_us, step FROM a WHERE step IS NOT NULL")
def w12(t):
    return X.step_signal(t.mains, ["house"], 3, rows_per_chunk=512).where("step is not null")


@query("w11_edge_pairs", "house:i t_on_us:i t_off_us:i dur_s:d", views="mains", sql=STEP_SQL + """,
r AS (SELECT house, ts_us FROM p WHERE step > 25 AND NOT coalesce(prev > 25, false)),
f AS (SELECT house, ts_us FROM p WHERE -step > 15 AND NOT coalesce(-prev > 15, false)),
j AS (SELECT r.house, r.ts_us AS t_on_us, min(f.ts_us) AS t_off_us FROM r JOIN f ON r.house = f.house AND f.ts_us > r.ts_us GROUP BY r.house, r.ts_us)
SELECT *, (t_off_us - t_on_us) / 1e6 AS dur_s FROM j WHERE (t_off_us - t_on_us) / 1e6 >= 600""")
def w11(t):
    s = X.step_signal(t.mains, ["house"], 3, rows_per_chunk=512)
    rises = X.rising_edges(s, F.col("step"), F.col("prev_step"), 25.0)
    falls = X.rising_edges(s, -F.col("step"), -F.col("prev_step"), 15.0)
    return X.episodes_from_edges(rises, falls, ["house"], 600.0)


@query("w13_rolling_mean_median", "house:i ts_us:i mean5:d med5:d", views="mains", sql="""
SELECT house, ts_us, avg(w) OVER f AS mean5, quantile_cont(w, 0.5) OVER f AS med5 FROM mains
WINDOW f AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w13(t):
    return X.rolling(t.mains, ["house"], 2, 2, {"mean5": F.avg("w"), "med5": F.percentile("w", 0.5)}, rows_per_chunk=512)


@query("w14_steps", "house:i d_p50:d d_p90:d d_p99:d noise_floor:d n30:i n100:i n300:i", views="mains", sql="""
WITH a AS (SELECT house, w, lag(w) OVER (PARTITION BY house ORDER BY ts_us, seq) AS p FROM mains),
q AS (SELECT house, quantile_cont(w, 0.25) AS p25 FROM mains GROUP BY house),
b AS (SELECT a.house, abs(w - p) AS d, w < p25 AND p < p25 AS quiet FROM a JOIN q ON a.house = q.house WHERE p IS NOT NULL)
SELECT house, quantile_cont(d, 0.5) AS d_p50, quantile_cont(d, 0.9) AS d_p90, quantile_cont(d, 0.99) AS d_p99,
 quantile_cont(CASE WHEN quiet THEN d END, 0.5) AS noise_floor, count(*) FILTER (d > 30) AS n30, count(*) FILTER (d > 100) AS n100,
 count(*) FILTER (d > 300) AS n300 FROM b GROUP BY house""")
def w14(t):
    d = with_quantiles(t.mains, ["house"], {"p25": ("w", 0.25)})
    d = X.with_previous(d, ["house"], ["w"]).where("prev_w is not null")
    d = d.select("house", F.abs(F.col("w") - F.col("prev_w")).alias("d"),
                 ((F.col("w") < F.col("p25")) & (F.col("prev_w") < F.col("p25"))).alias("quiet"))
    d = d.withColumn("dq", F.when(F.col("quiet"), F.col("d")))
    q = exact_quantiles(d, ["house"], {"d_p50": ("d", 0.5), "d_p90": ("d", 0.9), "d_p99": ("d", 0.99),
                                       "noise_floor": ("dq", 0.5)})
    n = d.groupBy("house").agg(*[F.count_if(F.col("d") > k).alias(f"n{k}") for k in (30, 100, 300)])
    return q.join(n, "house")


@query("w15_onset_steps", "meter:i ts_us:i dp_w:d", views="readings", sql="""
SELECT meter, ts_us, w - p AS dp_w FROM (SELECT *, lag(w) OVER o AS p, lag(ts_us) OVER o AS pt FROM readings
 WINDOW o AS (PARTITION BY meter ORDER BY ts_us, seq)) WHERE w - p >= 30 AND (ts_us - pt) / 1e6 <= 21600""")
def w15(t):
    d = X.with_previous(t.readings, ["meter"], ["w"], chunk_us=CH)
    return d.withColumn("dp_w", F.col("w") - F.col("prev_w")).where("dp_w >= 30 and dt_s <= 21600")


@query("w16_autocorrelation", "house:i lag:i r:d", views="mains", sql="""
WITH a AS (SELECT house, w, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) AS i FROM mains)
SELECT x.house, k AS lag, corr(x.w, y.w) AS r FROM a x CROSS JOIN (VALUES (1), (2), (12), (288)) AS l(k)
JOIN a y ON x.house = y.house AND y.i = x.i + k GROUP BY x.house, k""")
def w16(t):
    """Each row is sent to i + lag for every lag and meets its partner there."""
    a = X.numbered(t.mains, ["house"]).select("house", "i", "w")
    lags = F.array(*[F.lit(k) for k in (1, 2, 12, 288)])
    sent = a.select("house", F.explode(lags).alias("lag"), "i", F.col("w").alias("w0")).withColumn("i", F.col("i") + F.col("lag"))
    return sent.join(a, ["house", "i"]).groupBy("house", "lag").agg(F.corr("w0", "w").alias("r"))


@query("w17_frozen_runs", "t0_us:i t1_us:i w:d n_rows:i len_s:d", sql="""
WITH a AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, floor(value / 20) * 20 AS w FROM events),
b AS (SELECT *, CASE WHEN w = lag(w) OVER (ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (ORDER BY ts_us, seq) AS rid FROM b)
SELECT min(ts_us) AS t0_us, max(ts_us) AS t1_us, min(w) AS w, count(*) AS n_rows, count(*) * 250.0 AS len_s FROM c GROUP BY rid
HAVING count(*) * 250.0 >= 1250""")
def w17(t):
    d = t.mains.select(F.lit(0).alias("k"), "ts_us", "seq", (F.floor(F.col("w") / 20) * 20).cast("double").alias("w"))
    return X.frozen_runs(d, ["k"], 1250.0, 250.0)


@query("w17_clean_energy", "raw_wh:d clean_wh:d frozen_rows:i", sql="""
WITH a AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, floor(value / 20) * 20 AS w FROM events),
b AS (SELECT *, CASE WHEN w = lag(w) OVER (ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (ORDER BY ts_us, seq) AS rid FROM b),
d AS (SELECT sum(w) AS sw, count(*) AS n FROM c GROUP BY rid)
SELECT sum(sw) * 250 / 3600.0 AS raw_wh, sum(CASE WHEN n * 250.0 >= 1250 THEN 0 ELSE sw END) * 250 / 3600.0 AS clean_wh,
 sum(CASE WHEN n * 250.0 >= 1250 THEN n ELSE 0 END) AS frozen_rows FROM d""")
def w17_clean(t):
    """A frozen run holds one value, so its energy is value x rows x cadence."""
    d = t.mains.select(F.lit(0).alias("k"), "ts_us", "seq", (F.floor(F.col("w") / 20) * 20).cast("double").alias("w"))
    runs = X.frozen_runs(d, ["k"], 0.0, 250.0)
    bad = F.col("len_s") >= 1250
    e = F.col("w") * F.col("len_s") / 3600
    return runs.agg(F.sum(e).alias("raw_wh"), F.sum(F.when(~bad, e).otherwise(0.0)).alias("clean_wh"),
                    F.sum(F.when(bad, F.col("n_rows")).otherwise(0)).alias("frozen_rows"))


SESS = """
{n}_a AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {k} ORDER BY ts_us, seq) <= {tol} THEN 0 ELSE 1 END AS brk FROM {src}),
{n}_b AS (SELECT *, sum(brk) OVER (PARTITION BY {k} ORDER BY ts_us, seq) AS sid FROM {n}_a),
{n} AS (SELECT {k}, min(ts_us) AS t0_us, max(ts_us) AS t1_us, count(*) AS n_rows FROM {n}_b GROUP BY {k}, sid)"""


@query("w18_sessions", "meter:i t0_us:i t1_us:i n_rows:i", views="readings",
       ctes=SESS.format(n="ses", k="meter", tol=12 * H, src="readings"), sql="SELECT * FROM ses")
def w18(t):
    return X.sessions(t.readings, ["meter"], 43200, chunk_us=CH)


@query("w18_chunk_stats", "meter:i longest_d:d long_sum_d:d n_long:i", views="readings",
       ctes=SESS.format(n="ses", k="meter", tol=12 * H, src="readings"), sql="""
WITH d AS (SELECT meter, (t1_us - t0_us) / 86400e6 AS span FROM ses)
SELECT meter, max(span) AS longest_d, sum(CASE WHEN span >= 1 THEN span ELSE 0 END) AS long_sum_d, count(*) FILTER (span >= 2) AS n_long
FROM d GROUP BY meter""")
def w18_stats(t):
    s = X.sessions(t.readings, ["meter"], 43200, chunk_us=CH).withColumn("span", (F.col("t1_us") - F.col("t0_us")) / 86400e6)
    return s.groupBy("meter").agg(F.max("span").alias("longest_d"),
                                  F.sum(F.when(F.col("span") >= 1, F.col("span")).otherwise(0.0)).alias("long_sum_d"),
                                  F.count_if(F.col("span") >= 2).alias("n_long"))


@query("w19_gap_list", "meter:i ts_us:i dt_s:d", views="readings", sql="""
SELECT meter, ts_us, (nx - ts_us) / 1e6 AS dt_s FROM (SELECT *, lead(ts_us) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS nx FROM readings)
WHERE (nx - ts_us) / 1e6 > 86400""")
def w19(t):
    return X.gaps(t.readings, ["meter"], chunk_us=CH).where("dt_s > 86400")


@query("w19_dark_time", "meter:i n_gaps:i dark_s:d longest_s:d", views="readings", sql="""
WITH g AS (SELECT meter, (nx - ts_us) / 1e6 AS dt_s FROM (SELECT *, lead(ts_us) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS nx FROM readings))
SELECT meter, count(*) AS n_gaps, sum(dt_s) AS dark_s, max(dt_s) AS longest_s FROM g WHERE dt_s > 43200 GROUP BY meter""")
def w19_dark(t):
    g = X.gaps(t.readings, ["meter"], chunk_us=CH).where("dt_s > 43200")
    return g.groupBy("meter").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("dt_s").alias("dark_s"), F.max("dt_s").alias("longest_s"))


@query("w20_dense_start", "meter:i dense_us:i", views="readings", sql="""
SELECT meter, min(ts_us) AS dense_us FROM (SELECT *, count(*) OVER (PARTITION BY meter ORDER BY ts_us
  RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n FROM readings) WHERE n >= 18 GROUP BY meter""")
def w20(t):
    return X.dense_start(t.readings, ["meter"], 18, 7 * 86400)


@query("w21_two_leg_steps", "house:i n_pairs:i n_rise:i n_fall:i n_counter:i med_a:d med_b:d", sql="""
WITH legs AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS hr, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS a,
  avg(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY 1, 2),
p AS (SELECT house, hr, a - lag(a) OVER o AS da, b - lag(b) OVER o AS db, hr - lag(hr) OVER o AS dt FROM legs
  WHERE a IS NOT NULL AND b IS NOT NULL WINDOW o AS (PARTITION BY house ORDER BY hr)),
q AS (SELECT *, da >= 15 AND db >= 15 AS up, da <= -15 AND db <= -15 AS dn,
  (da >= 15 AND db <= -15) OR (da <= -15 AND db >= 15) AS ct FROM p WHERE dt BETWEEN 1 AND 3)
SELECT house, count(*) AS n_pairs, count(*) FILTER (up) AS n_rise, count(*) FILTER (dn) AS n_fall, count(*) FILTER (ct) AS n_counter,
 quantile_cont(CASE WHEN up THEN da END, 0.5) AS med_a, quantile_cont(CASE WHEN up THEN db END, 0.5) AS med_b FROM q GROUP BY house""")
def w21(t):
    hr = bucket_of("ts_us", H)
    even = F.col("seq") % 2 == 0
    legs = (t.mains.groupBy("house", hr.alias("hr")).agg(F.avg(F.when(even, F.col("w"))).alias("a"), F.avg(F.when(~even, F.col("w"))).alias("b"))
            .where("a is not null and b is not null"))
    p = ordered_scan(legs, ["house"], ["hr"], bucket_of("hr", 168), lag={"pa": "a", "pb": "b", "ph": "hr"})
    p = p.where((F.col("hr") - F.col("ph")).between(1, 3)).select("house", (F.col("a") - F.col("pa")).alias("da"), (F.col("b") - F.col("pb")).alias("db"))
    da, db = F.col("da"), F.col("db")
    up, dn = (da >= 15) & (db >= 15), (da <= -15) & (db <= -15)
    ct = ((da >= 15) & (db <= -15)) | ((da <= -15) & (db >= 15))
    p = p.select("house", up.alias("up"), dn.alias("dn"), ct.alias("ct"), F.when(up, da).alias("ua"), F.when(up, db).alias("ub"))
    n = p.groupBy("house").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("up").alias("n_rise"), F.count_if("dn").alias("n_fall"),
                               F.count_if("ct").alias("n_counter"))
    return n.join(exact_quantiles(p, ["house"], {"med_a": ("ua", 0.5), "med_b": ("ub", 0.5)}), "house", "left")


@query("w22_careers", "house:i device:s t_on_us:i t_off_us:i n_merged:i energy_wh:d", views="channels",
       ctes=episodes_sql("channels", "house, device", "w > 30", merge_s=28800, dwell_s=0), sql="SELECT * FROM ep")
def w22(t):
    return channel_episodes(t, merge_s=28800, dwell_s=0.0)


@query("w23_blocks_and_boils", "device:s kind:s n:i dur_p50:d", views="devices",
       ctes=episodes_sql("devices", "device", "w > 100", merge_s=0, dwell_s=900, hold_s=3600, name="blk") + ","
       + episodes_sql("devices", "device", "w > 50", merge_s=1800, dwell_s=20, hold_s=3600, name="boil"), sql="""
SELECT device, 'block' AS kind, count(*) AS n, quantile_cont(dur_s, 0.5) AS dur_p50 FROM blk GROUP BY device
UNION ALL SELECT device, 'boil', count(*), quantile_cont(dur_s, 0.5) FROM boil GROUP BY device""")
def w23(t):
    d = t.devices
    blk = X.build_episodes(d, ["device"], 100.0, min_dwell_s=900, merge_gap_s=0, max_hold_s=3600)
    boil = X.build_episodes(d, ["device"], 50.0, min_dwell_s=20, merge_gap_s=1800, max_hold_s=3600)
    both = blk.withColumn("kind", F.lit("block")).unionByName(boil.withColumn("kind", F.lit("boil")))
    return exact_quantiles(both, ["device", "kind"], {"dur_p50": ("dur_s", 0.5)}, {"n": "dur_s"})


SPANS_SQL = """
spans AS (SELECT user_id % 5 AS house, epoch_us(ts) AS t0_us, epoch_us(ts) + CAST(floor(value * 6e7) AS BIGINT) AS t1_us, value AS dp FROM events),
chain_a AS (SELECT *, max(t1_us) OVER (PARTITION BY house ORDER BY t0_us, t1_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
chain_b AS (SELECT *, CASE WHEN t0_us - reach <= {gap} THEN 0 ELSE 1 END AS brk FROM chain_a),
chain_c AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY t0_us, t1_us) AS cid FROM chain_b)"""


def spans(t):
    """Overlapping runs: each reading lasts as many minutes as it has watts."""
    return t.mains.select("house", F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.floor(F.col("w") * 6e7)).alias("t1_us"), F.col("w").alias("dp"))


@query("w24_chained_runs", "house:i t0_us:i t1_us:i n_merged:i", ctes=SPANS_SQL.format(src="(SELECT * FROM spans WHERE dp >= 40)", gap=300000000),
       sql="SELECT house, min(t0_us) AS t0_us, max(t1_us) AS t1_us, count(*) AS n_merged FROM chain_c GROUP BY house, cid")
def w24(t):
    return X.chain_runs(spans(t).where("dp >= 40"), ["house"], 300_000_000, chunk_us=CH)


@query("w25_anchored_windows", "house:i c0_us:i c1_us:i anchor_us:i n_merged:i", sql="""
WITH q AS (SELECT user_id % 5 AS house, epoch_us(ts) AS t0 FROM events WHERE value >= 100),
w AS (SELECT house, t0, t0 - 1800000000 AS c0, t0 - 1800000000 + 7200000000 AS c1 FROM q),
a AS (SELECT *, max(c1) OVER (PARTITION BY house ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
b AS (SELECT *, CASE WHEN c0 - reach <= -3600000000 THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY c0, c1) AS g FROM b)
SELECT house, min(c0) AS c0_us, max(c1) AS c1_us, min_by(t0, c0) AS anchor_us, count(*) AS n_merged FROM c GROUP BY house, g""")
def w25(t):
    return X.anchored_windows(spans(t).where("dp >= 100"), ["house"], 7200.0, chunk_us=CH)


@query("w26_best_window", "house:i ts_us:i sum_w:d n_rows:i", views="mains", sql="""
WITH a AS (SELECT house, ts_us, sum(w) OVER f AS sum_w, count(*) OVER f AS n_rows, avg(CASE WHEN w > 100 THEN 1.0 ELSE 0.0 END) OVER f AS sh FROM mains
  WINDOW f AS (PARTITION BY house ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 43199999999 FOLLOWING))
SELECT house, max_by(ts_us, (sum_w, -ts_us)) AS ts_us, max(sum_w) AS sum_w, max_by(n_rows, (sum_w, -ts_us)) AS n_rows FROM a WHERE sh <= 0.25 GROUP BY house""")
def w26(t):
    return X.best_window(t.mains, ["house"], 12 * 3600, F.col("w"), on=F.col("w") > 100, max_share=0.25)


@query("w26_busiest_day", "house:i day:i spread_w:d", views="mains", sql="""
WITH d AS (SELECT house, ts_us // 86400000000 AS day, count(*) AS n, quantile_cont(w, 0.995) - quantile_cont(w, 0.05) AS sp FROM mains GROUP BY 1, 2)
SELECT house, max_by(day, (sp, -day)) AS day, max(sp) AS spread_w FROM d WHERE n >= 40 GROUP BY house""")
def w26_day(t):
    d = exact_quantiles(t.mains.withColumn("day", bucket_of("ts_us", DAY_US)), ["house", "day"],
                        {"hi": ("w", 0.995), "lo": ("w", 0.05)}, {"n": "w"}).where("n >= 40")
    d = d.withColumn("sp", F.col("hi") - F.col("lo"))
    return d.groupBy("house").agg(F.max_by("day", F.struct("sp", -F.col("day"))).alias("day"), F.max("sp").alias("spread_w"))


@query("w26_active_day_window", "house:i day:i energy:d", views="mains", sql="""
WITH d AS (SELECT house, ts_us // 86400000000 AS day, sum(w) AS e, count(*) AS n FROM mains GROUP BY 1, 2),
w AS (SELECT a.house, a.day, sum(b.e) AS e, sum(b.n) AS n FROM d a JOIN d b ON a.house = b.house AND b.day BETWEEN a.day AND a.day + 2 GROUP BY 1, 2)
SELECT house, max_by(day, (e, -day)) AS day, max(e) AS energy FROM w WHERE n >= 100 GROUP BY house""")
def w26_active(t):
    """Most active three-day window among day-aligned starts, on daily partial sums."""
    d = t.mains.groupBy("house", bucket_of("ts_us", DAY_US).alias("day")).agg(F.sum("w").alias("e"), F.count(F.lit(1)).alias("n"))
    f = W.partitionBy("house").orderBy("day").rangeBetween(0, 2)
    d = d.select("house", "day", F.sum("e").over(f).alias("e"), F.sum("n").over(f).alias("n")).where("n >= 100")
    return d.groupBy("house").agg(F.max_by("day", F.struct("e", -F.col("day"))).alias("day"), F.max("e").alias("energy"))


@query("w27_gated_cumulative", "house:i ts_us:i gated_cum:i", views="mains", sql="""
SELECT house, ts_us, sum(CASE WHEN w > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY house ORDER BY ts_us, seq) AS gated_cum FROM mains""")
def w27(t):
    d = t.mains.withColumn("g", F.coalesce(F.col("w") > 150, F.lit(False)).cast("int"))
    return ordered_scan(d, ["house"], ["ts_us", "seq"], bucket_of("ts_us", DAY_US), running_sum={"gated_cum": "g"})


@query("w28_representative_episode", "device:s t_on_us:i dur_s:d", views="channels", ctes=CHANNEL_EP, sql="""
WITH p AS (SELECT device, quantile_cont(dur_s, 0.5) AS p50 FROM ep GROUP BY device)
SELECT ep.device, min_by(t_on_us, (abs(dur_s - p50), t_on_us)) AS t_on_us, min_by(dur_s, (abs(dur_s - p50), t_on_us)) AS dur_s
FROM ep JOIN p ON ep.device = p.device GROUP BY ep.device""")
def w28(t):
    ep = with_quantiles(channel_episodes(t).select("device", "t_on_us", "dur_s"), ["device"], {"p50": ("dur_s", 0.5)})
    best = F.min_by(F.struct("t_on_us", "dur_s"), F.struct(F.abs(F.col("dur_s") - F.col("p50")), F.col("t_on_us")))
    return ep.groupBy("device").agg(best.alias("b")).select("device", "b.*")


@query("w29_dwell_ecdf", "device:s dur_s:d ecdf:d", views="channels", ctes=CHANNEL_EP, sql="""
SELECT device, dur_s, max(c) AS ecdf FROM (SELECT device, dur_s, cume_dist() OVER (PARTITION BY device ORDER BY dur_s) AS c FROM ep) GROUP BY device, dur_s""")
def w29(t):
    """Counts per value, then a chunked running share."""
    from ..operators.quantiles import value_bucket

    f = channel_episodes(t).groupBy("device", "dur_s").agg(F.count(F.lit(1)).alias("n"))
    r = ordered_scan(f, ["device"], ["dur_s"], value_bucket(F.col("dur_s")), running_sum={"c": "n"}, total={"tot": "n"})
    return r.withColumn("ecdf", F.col("c") / F.col("tot"))


# ------------------------------------------------------------------------------ energy

@query("g01_hold_energy", "meter:i ts_us:i e_wh:d cum_wh:d", views="readings", sql="""
WITH a AS (SELECT *, w * least(coalesce(lead(ts_us) OVER (PARTITION BY meter ORDER BY ts_us, seq) - ts_us, 0), 43200000000) / 3.6e9 AS e_wh FROM readings)
SELECT meter, ts_us, e_wh, sum(e_wh) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS cum_wh FROM a""")
def g01(t):
    return E.cumulative_energy(t.readings, ["meter"], 43200, chunk_us=CH)


@query("g02_window_energy", "house:i device:s t_on_us:i energy_wh:d", views="channels mains", ctes=CHANNEL_EP, sql="""
WITH e AS (SELECT house, ts_us, w * least(coalesce(lead(ts_us) OVER (PARTITION BY house ORDER BY ts_us, seq) - ts_us, 0), 3600000000) / 3.6e9 AS e FROM mains)
SELECT ep.house, ep.device, ep.t_on_us, greatest(coalesce(sum(e.e), 0), 0) AS energy_wh FROM ep LEFT JOIN e
 ON ep.house = e.house AND e.ts_us BETWEEN ep.t_on_us AND ep.t_off_us GROUP BY 1, 2, 3""")
def g02(t):
    """Mains energy inside each device episode (bounds inclusive)."""
    ep = channel_episodes(t).select("house", "device", "t_on_us", "t_off_us")
    win = ep.select("house", "t_on_us", "t_off_us").distinct()
    e = E.window_energy(t.mains, win, ["house"], start="t_on_us", end="t_off_us", max_hold_s=3600)
    return ep.join(e, ["house", "t_on_us", "t_off_us"])


PAIRS = "WITH g AS (SELECT *, lead(w) OVER o AS nw, (lead(ts_us) OVER o - ts_us) / 1e6 AS dt FROM readings WINDOW o AS (PARTITION BY meter ORDER BY ts_us, seq))"


@query("g03_uncapped_energy", "meter:i energy_kwh:d n_pairs:i", PAIRS + """
SELECT meter, sum(w * dt) / 3.6e6 AS energy_kwh, count(nw) AS n_pairs FROM g WHERE nw IS NOT NULL GROUP BY meter""", views="readings")
def g03(t):
    return E.pair_energy(t.readings, ["meter"], chunk_us=CH)


@query("g04_capped_energy", "meter:i energy_kwh:d", PAIRS + """
SELECT meter, sum(w * least(dt, 21600)) / 3.6e6 AS energy_kwh FROM g WHERE nw IS NOT NULL GROUP BY meter""", views="readings")
def g04(t):
    return E.pair_energy(t.readings, ["meter"], cap_s=21600, chunk_us=CH)


@query("g05_gap_dropping_energy", "meter:i energy_kwh:d", PAIRS + """
SELECT meter, sum(CASE WHEN dt <= 43200 THEN w * dt ELSE 0 END) / 3.6e6 AS energy_kwh FROM g WHERE nw IS NOT NULL GROUP BY meter""", views="readings")
def g05(t):
    return E.pair_energy(t.readings, ["meter"], drop_over_s=43200, chunk_us=CH)


@query("g06_cadence_energy", "device:s dt_med_s:d energy_kwh:d", views="devices", sql="""
WITH g AS (SELECT device, w, (lead(ts_us) OVER (PARTITION BY device ORDER BY ts_us, seq) - ts_us) / 1e6 AS dt FROM devices)
SELECT device, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS dt_med_s, sum(w) * quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) / 3.6e6 AS energy_kwh FROM g GROUP BY device""")
def g06(t):
    g = X.gaps(t.devices, ["device"]).where("dt_s > 0")
    dt = exact_quantiles(g, ["device"], {"dt_med_s": ("dt_s", 0.5)})
    s = t.devices.groupBy("device").agg(F.sum("w").alias("sw"))
    return s.join(dt, "device").withColumn("energy_kwh", F.col("sw") * F.col("dt_med_s") / 3.6e6)


@query("g07_energy_balance", "house:i total_wh:d attributed_wh:d floor_wh:d residual_wh:d residual_share:d", views="channels mains", ctes=CHANNEL_EP, sql="""
WITH e AS (SELECT house, ts_us, w, least(coalesce(lead(ts_us) OVER (PARTITION BY house ORDER BY ts_us, seq) - ts_us, 0), 3600000000) AS h FROM mains),
fl AS (SELECT house, quantile_cont(w, 0.1) AS f FROM mains GROUP BY house),
m AS (SELECT e.house, sum(w * h) / 3.6e9 AS total_wh, sum(f * h) / 3.6e9 AS floor_wh FROM e JOIN fl ON e.house = fl.house GROUP BY e.house),
a AS (SELECT house, sum(energy_wh) AS attributed_wh FROM ep GROUP BY house)
SELECT m.house, total_wh, attributed_wh, floor_wh, total_wh - attributed_wh - floor_wh AS residual_wh,
 (total_wh - attributed_wh - floor_wh) / total_wh AS residual_share FROM m JOIN a ON m.house = a.house""")
def g07(t):
    e = E.hold_energy(with_quantiles(t.mains, ["house"], {"f": ("w", 0.1)}), ["house"], 3600)
    held = F.coalesce(F.least("next_us", F.col("ts_us") + 3_600_000_000) - F.col("ts_us"), F.lit(0))
    held = F.when(F.col("next_us").isNull(), 0).otherwise(held)
    m = e.groupBy("house").agg(F.sum("e_wh").alias("total_wh"), (F.sum(F.col("f") * held) / 3.6e9).alias("floor_wh"))
    a = channel_episodes(t).groupBy("house").agg(F.sum("energy_wh").alias("attributed_wh"))
    return m.join(a, "house").select("*", *E.energy_balance(F.col("total_wh"), F.col("attributed_wh"), F.col("floor_wh")))


@query("g08_energy_share_rank", "house:i device:s kwh:d share:d rank:i annual_kwh:d", views="channels", sql="""
WITH g AS (SELECT house, device, sum(w * least(coalesce(nx - ts_us, 0), 7200000000)) / 3.6e12 AS kwh, (max(ts_us) - min(ts_us)) / 86400e6 AS days
 FROM (SELECT *, lead(ts_us) OVER (PARTITION BY house, device ORDER BY ts_us, seq) AS nx FROM channels) GROUP BY 1, 2)
SELECT house, device, kwh, kwh / sum(kwh) OVER (PARTITION BY house) AS share, rank() OVER (PARTITION BY house ORDER BY kwh DESC) AS rank,
 kwh / days * 365.25 AS annual_kwh FROM g""")
def g08(t):
    e = E.hold_energy(t.channels, ["house", "device"], 7200, chunk_us=CH)
    g = e.groupBy("house", "device").agg((F.sum("e_wh") / 1000).alias("kwh"), ((F.max("ts_us") - F.min("ts_us")) / 86400e6).alias("days"))
    h = W.partitionBy("house")
    return g.select("house", "device", "kwh", (F.col("kwh") / F.sum("kwh").over(h)).alias("share"),
                    F.rank().over(h.orderBy(F.col("kwh").desc())).alias("rank"), (F.col("kwh") / F.col("days") * 365.25).alias("annual_kwh"))


@query("g09_monthly_energy", "ym:i kwh:d days:i kwh_per_day:d winter_over_summer:d", sql="""
WITH d AS (SELECT o_orderdate AS ts, sum(o_totalprice) / 1000 AS e FROM orders GROUP BY 1),
m AS (SELECT CAST(strftime(ts, '%Y%m') AS BIGINT) AS ym, sum(e) AS kwh, count(*) AS days FROM d GROUP BY 1),
r AS (SELECT avg(CASE WHEN ym % 100 IN (12, 1, 2) THEN kwh / days END) / avg(CASE WHEN ym % 100 IN (6, 7, 8) THEN kwh / days END) AS x FROM m)
SELECT ym, kwh, days, kwh / days AS kwh_per_day, x AS winter_over_summer FROM m, r""")
def g09(t):
    day = t.orders.groupBy("o_orderdate").agg((F.sum("o_totalprice") / 1000).alias("e"))
    m = day.groupBy(F.date_format("o_orderdate", "yyyyMM").cast("bigint").alias("ym")).agg(F.sum("e").alias("kwh"), F.count(F.lit(1)).alias("days"))
    m = m.withColumn("kwh_per_day", F.col("kwh") / F.col("days"))
    mo = F.col("ym") % 100
    r = m.agg((F.avg(F.when(mo.isin(12, 1, 2), F.col("kwh_per_day"))) / F.avg(F.when(mo.isin(6, 7, 8), F.col("kwh_per_day")))).alias("winter_over_summer"))
    return m.crossJoin(F.broadcast(r))  # one row


@query("g10_observed_vs_mean", "device:s observed_kwh:d own_mean_kwh:d naive_kwh:d", views="devices", sql="""
WITH g AS (SELECT *, (lead(ts_us) OVER (PARTITION BY device ORDER BY ts_us, seq) - ts_us) / 1e6 AS dt FROM devices),
s AS (SELECT device, sum(w * least(coalesce(dt, 0), 600)) / 3.6e6 AS observed_kwh, avg(w) AS mw, sum(least(coalesce(dt, 0), 600)) AS obs_s, (max(ts_us) - min(ts_us)) / 1e6 AS span FROM g GROUP BY device)
SELECT device, observed_kwh, mw * obs_s / 3.6e6 AS own_mean_kwh, mw * span / 3.6e6 AS naive_kwh FROM s""")
def g10(t):
    g = X.gaps(t.devices, ["device"], keep_last=True)
    c = F.when(F.col("dt_s").isNotNull(), F.least("dt_s", F.lit(600.0)))
    s = g.groupBy("device").agg((F.sum(F.col("w") * c) / 3.6e6).alias("observed_kwh"), F.avg("w").alias("mw"), F.sum(c).alias("obs_s"),
                                ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span"))
    return s.select("device", "observed_kwh", (F.col("mw") * F.col("obs_s") / 3.6e6).alias("own_mean_kwh"), (F.col("mw") * F.col("span") / 3.6e6).alias("naive_kwh"))


@query("g11_unknown_share", "house:i unknown_share:d", views="mains", sql="""
WITH e AS (SELECT house, w, w * least(coalesce(lead(ts_us) OVER (PARTITION BY house ORDER BY ts_us, seq) - ts_us, 0), 3600000000) AS e FROM mains)
SELECT house, sum(CASE WHEN w > 120 THEN e ELSE 0 END) / sum(e) AS unknown_share FROM e GROUP BY house""")
def g11(t):
    e = E.hold_energy(t.mains, ["house"], 3600)
    return e.groupBy("house").agg((F.sum(F.when(F.col("w") > 120, F.col("e_wh")).otherwise(0.0)) / F.sum("e_wh")).alias("unknown_share"))


@query("p07_asof_unbounded", "meter:i ts_us:i last_big_us:i last_big_w:d", views="readings", sql="""
WITH b AS (SELECT meter, ts_us, w FROM readings WHERE w > 80)
SELECT r.meter, r.ts_us, b.ts_us AS last_big_us, b.w AS last_big_w FROM readings r ASOF LEFT JOIN b ON r.meter = b.meter AND r.ts_us >= b.ts_us""")
def asof_unbounded(t):
    """The latest large reading before each row, however old."""
    r = t.readings.select("meter", "ts_us")
    big = t.readings.where("w > 80").select("meter", "ts_us", "w")
    return last_before(r, big, ["meter"], ["w"], chunk_us=CH).select("meter", "ts_us", F.col("r_ts_us").alias("last_big_us"), F.col("r_w").alias("last_big_w"))
