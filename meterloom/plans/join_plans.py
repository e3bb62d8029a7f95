"""Queries on exact, as-of, nearest, interval and overlap joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import episodes as X
from ..operators import profiles as PR
from ..operators.joins import asof_join, next_after, overlap_join, points_in
from ..operators.ordered import DAY_US, bucket_of, join_dim, ordered_scan
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..sources.readings import mains_of
from .audit_plans import LABELS_SQL, labels5
from .catalog import query
from .series_plans import CH, CHANNEL_EP, H, channel_episodes, spans

HB = 6 * H  # bucket of interval joins on the sparse test stream
EP_COLS = ["house", "device", "t_on_us", "t_off_us"]


@query("j01_site_mains", "house:i ts_us:i w:d n_legs:i", sql="""
SELECT house, ts_us, sum(w) AS w, count(w) AS n_legs FROM (SELECT user_id % 5 AS house, epoch_us(ts) // 600000000 * 600000000 AS ts_us, value AS w FROM events) GROUP BY 1, 2""")
def j01(t):
    """Sum of the legs on the union of their stamps (ten-minute grid here)."""
    d = t.mains.withColumn("ts_us", bucket_of("ts_us", 600_000_000) * 600_000_000)
    return mains_of(d, ["house"])


@query("j02_outer_align", "hr:i a:d b:d total:d", sql="""
WITH l AS (SELECT epoch_us(ts) // 1800000000 AS hr, sum(value) AS a FROM events WHERE event_type = 'click' GROUP BY 1),
r AS (SELECT epoch_us(ts) // 1800000000 AS hr, sum(value) AS b FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(l.hr, r.hr) AS hr, a, b, coalesce(a, 0) + coalesce(b, 0) AS total FROM l FULL OUTER JOIN r ON l.hr = r.hr""")
def j02(t):
    d = t.devices.withColumn("hr", bucket_of("ts_us", H // 2))
    leg = lambda n, o: d.where(F.col("device") == n).groupBy("hr").agg(F.sum("w").alias(o))
    j = leg("click", "a").join(leg("view", "b"), "hr", "full_outer")
    return j.withColumn("total", F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))


@query("j03_exact_stamp_join", "house:i n:i mae:d", sql="""
WITH a AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS g, avg(value) AS p FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS g, avg(value) AS q FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT a.house, count(*) AS n, avg(abs(p - q)) AS mae FROM a JOIN b ON a.house = b.house AND a.g = b.g GROUP BY a.house""")
def j03(t):
    g = bucket_of("ts_us", H).alias("g")
    a = t.channels.where("device = 'click'").groupBy("house", g).agg(F.avg("w").alias("p"))
    b = t.channels.where("device = 'view'").groupBy("house", g).agg(F.avg("w").alias("q"))
    return a.join(b, ["house", "g"]).groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("mae"))


NEAR = """
near AS (SELECT g.house, g.ts_us, c.ts_us AS r_us, c.w AS r_w, row_number() OVER (PARTITION BY g.house, g.ts_us ORDER BY abs(c.ts_us - g.ts_us), c.ts_us DESC) AS k
 FROM {left} g JOIN (SELECT * FROM channels WHERE device = 'click') c ON g.house = c.house AND c.ts_us BETWEEN g.ts_us - {tol} AND g.ts_us + {tol})"""


@query("j04_nearest_to_grid", "house:i ts_us:i w:d", views="mains channels", ctes=NEAR.format(left="mains", tol=H // 2), sql="""
SELECT m.house, m.ts_us, coalesce(r_w, 0) AS w FROM mains m LEFT JOIN (SELECT * FROM near WHERE k = 1) n ON m.house = n.house AND m.ts_us = n.ts_us""")
def j04(t):
    """Nearest sample within half an hour onto the mains stamps, else 0; a tie takes the later."""
    click = t.channels.where("device = 'click'").select("house", "ts_us", "w")
    j = asof_join(t.mains.select("house", "ts_us"), click, ["house"], ["w"], tolerance_us=H // 2, direction="nearest")
    return j.select("house", "ts_us", F.coalesce("r_w", F.lit(0.0)).alias("w"))


@query("j05_cross_check", "n:i matched:i max_diff:d mismatches:i null_both:i", sql="""
WITH a AS (SELECT epoch_us(ts) AS ts_us, value AS v FROM events), b AS (SELECT epoch_us(ts) + event_id % 3 - 1 AS ts_us, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value + CASE WHEN event_id % 50 = 0 THEN 0.5 ELSE 0 END END AS v FROM events),
g AS (SELECT ts_us, CASE WHEN count(v) = count(*) THEN min(v) END AS lo, max(v) AS hi FROM b GROUP BY ts_us),
j AS (SELECT a.v, coalesce(e.ts_us, l.ts_us, p.ts_us) AS r_ts_us, CASE WHEN e.ts_us IS NOT NULL THEN e.lo WHEN l.ts_us IS NOT NULL THEN l.lo ELSE p.hi END AS r_v
 FROM a LEFT JOIN g e ON e.ts_us = a.ts_us LEFT JOIN g l ON l.ts_us = a.ts_us + 1 LEFT JOIN g p ON p.ts_us = a.ts_us - 1)
SELECT count(*) AS n, count(r_ts_us) AS matched, max(abs(v - r_v)) AS max_diff, count(*) FILTER (v <> r_v) AS mismatches, count(*) FILTER (r_ts_us IS NOT NULL AND r_v IS NULL) AS null_both FROM j""")
def j05(t):
    """Two copies of one series whose stamps differ by at most one microsecond: every reading of the first is checked once,
    against its nearest of the second. At equal distance the later counts; of readings with one stamp the
    least value (a missing one is the least), or the largest when only an earlier stamp is near."""
    a = t.devices.select(F.lit(0).alias("k"), "ts_us", F.col("w").alias("v"), "seq")
    other = F.when(F.col("seq") % 97 == 0, None).otherwise(F.col("v") + F.when(F.col("seq") % 50 == 0, 0.5).otherwise(0.0))
    b = a.select("k", (F.col("ts_us") + F.col("seq") % 3 - 1).alias("ts_us"), other.alias("v"))
    j = asof_join(a.select("k", "ts_us", "v"), b, ["k"], ["v"], tolerance_us=1, direction="nearest")
    hit = F.col("r_ts_us").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("matched"), F.max(F.abs(F.col("v") - F.col("r_v"))).alias("max_diff"),
                 F.count_if(F.col("v") != F.col("r_v")).alias("mismatches"), F.count_if(hit & F.col("r_v").isNull()).alias("null_both"))


@query("j06_asof_with_age", "house:i ts_us:i occ_us:i age_s:d", views="mains channels", sql="""
WITH o AS (SELECT house, ts_us FROM channels WHERE device = 'signup')
SELECT m.house, m.ts_us, o.ts_us AS occ_us, (m.ts_us - o.ts_us) / 1e6 AS age_s FROM mains m ASOF JOIN o ON m.house = o.house AND m.ts_us >= o.ts_us WHERE m.ts_us - o.ts_us <= 3600000000""")
def j06(t):
    occ = t.channels.where("device = 'signup'").select("house", "ts_us")
    j = asof_join(t.mains.select("house", "ts_us"), occ, ["house"], [], tolerance_us=H)
    return j.where("r_ts_us is not null").select("house", "ts_us", F.col("r_ts_us").alias("occ_us"), ((F.col("ts_us") - F.col("r_ts_us")) / 1e6).alias("age_s"))


@query("j07_state_at_midpoint", "device:s n:i other_on:i", views="channels", ctes=CHANNEL_EP, sql="""
WITH m AS (SELECT house, device, t_on_us, (t_on_us + t_off_us) // 2 AS mid FROM ep),
c AS (SELECT m.house, m.device, m.t_on_us, c.w, row_number() OVER (PARTITION BY m.house, m.device, m.t_on_us ORDER BY abs(c.ts_us - mid), c.ts_us DESC) AS k FROM m
 JOIN channels c ON c.house = m.house AND c.device = 'view' AND c.ts_us BETWEEN mid - 3600000000 AND mid + 3600000000)
SELECT m.device, count(*) AS n, count(*) FILTER (c.w > 30) AS other_on FROM m LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON m.house = c.house AND m.device = c.device AND m.t_on_us = c.t_on_us
WHERE m.device <> 'view' GROUP BY m.device""")
def j07(t):
    m = channel_episodes(t).where("device <> 'view'").select("house", "device", F.floor((F.col("t_on_us") + F.col("t_off_us")) / 2).alias("ts_us"))
    view = t.channels.where("device = 'view'").select("house", "ts_us", "w")
    j = asof_join(m, view, ["house"], ["w"], tolerance_us=H, direction="nearest")
    return j.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r_w") > 30).alias("other_on"))


OVER_SQL = """
WITH p AS (SELECT a.house, a.device AS device, a.t_on_us, a.t_off_us, b.device AS other, least(a.t_off_us, b.t_off_us) - greatest(a.t_on_us, b.t_on_us) AS ov
 FROM ep a JOIN ep b ON a.house = b.house AND a.device <> b.device AND a.t_on_us < b.t_off_us AND b.t_on_us < a.t_off_us)"""


def pairs(t, ep=None):
    ep = ep if ep is not None else channel_episodes(t).select(*EP_COLS)
    p = overlap_join(ep, ep, ["house"], left_span=("t_on_us", "t_off_us"), right_span=("t_on_us", "t_off_us"), bucket_us=4 * HB,
                     extra=F.col("l.device") != F.col("r.device"))
    ov = F.least("l.t_off_us", "r.t_off_us") - F.greatest("l.t_on_us", "r.t_on_us")
    return p.select("house", F.col("l.device").alias("device"), F.col("l.t_on_us").alias("t_on_us"), F.col("l.t_off_us").alias("t_off_us"),
                    F.col("r.device").alias("other"), F.col("r.t_on_us").alias("o_on_us"), F.col("r.t_off_us").alias("o_off_us"), ov.alias("ov"))


@query("j08_overlap_pairs", "house:i device:s t_on_us:i other:s ov:i", views="channels", ctes=CHANNEL_EP, sql=OVER_SQL + "SELECT * FROM p")
def j08(t):
    return pairs(t)


@query("j09_covered_by_union", "device:s n:i covered:i", views="channels", ctes=CHANNEL_EP, sql=OVER_SQL + """,
c AS (SELECT DISTINCT house, device, t_on_us FROM p)
SELECT ep.device, count(*) AS n, count(c.t_on_us) AS covered FROM ep LEFT JOIN c ON ep.house = c.house AND ep.device = c.device AND ep.t_on_us = c.t_on_us GROUP BY ep.device""")
def j09(t):
    ep = channel_episodes(t).select(*EP_COLS)
    f = PR.tag_cooccurring(ep, ["house"], bucket_us=4 * HB)
    return f.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if("co").alias("covered"))


@query("j10_cover_share", "house:i device:s t_on_us:i cover:d flagged:b", views="channels", ctes=CHANNEL_EP, sql=OVER_SQL + """
SELECT ep.house, ep.device, ep.t_on_us, coalesce(sum(ov), 0) / greatest(ep.t_off_us - ep.t_on_us, 1) AS cover, coalesce(sum(ov), 0) / greatest(ep.t_off_us - ep.t_on_us, 1) > 0.2 AS flagged
FROM ep LEFT JOIN p ON ep.house = p.house AND ep.device = p.device AND ep.t_on_us = p.t_on_us GROUP BY ep.house, ep.device, ep.t_on_us, ep.t_off_us""")
def j10(t):
    ep = channel_episodes(t).select(*EP_COLS)
    return PR.cover_share(ep, ep, ["house"], 0.20, bucket_us=4 * HB)


@query("j11_cooccurring", "house:i device:s t_on_us:i co:b", views="channels", ctes=CHANNEL_EP, sql=OVER_SQL + """
SELECT house, device, t_on_us, EXISTS (SELECT 1 FROM p WHERE p.house = ep.house AND p.device = ep.device AND p.t_on_us = ep.t_on_us) AS co FROM ep""")
def j11(t):
    ep = channel_episodes(t).select(*EP_COLS)
    return PR.tag_cooccurring(ep, ["house"], bucket_us=4 * HB)


@query("j12_onset_interference", "device:s n:i flagged:i", views="channels", ctes=CHANNEL_EP, sql="""
SELECT device, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM ep b WHERE b.house = a.house AND b.device <> a.device AND b.t_on_us <= a.t_on_us + 600000000 AND b.t_off_us >= a.t_on_us - 600000000)) AS flagged
FROM ep a GROUP BY device""")
def j12(t):
    ep = channel_episodes(t).select(*EP_COLS)
    return PR.onset_interference(ep, ["house"], 600.0, bucket_us=4 * HB).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if("interfered").alias("flagged"))


@query("j13_pairwise_additivity", "a:s b:s n_overlaps:i obs_p50:d pred_sum:d ratio_p50:d", views="channels mains", ctes=CHANNEL_EP, sql="""
WITH lv AS (SELECT device, avg(w) AS mu FROM channels WHERE w > 30 GROUP BY device),
p AS (SELECT a.house, a.device AS a, b.device AS b, greatest(a.t_on_us, b.t_on_us) AS s, least(a.t_off_us, b.t_off_us) AS e FROM ep a JOIN ep b ON a.house = b.house AND a.device < b.device
 AND least(a.t_off_us, b.t_off_us) - greatest(a.t_on_us, b.t_on_us) >= 3600000000),
o AS (SELECT p.a, p.b, p.house, p.s, p.e, avg(m.w) AS obs FROM p JOIN mains m ON m.house = p.house AND m.ts_us BETWEEN p.s AND p.e GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, count(*) AS n_overlaps, quantile_cont(obs, 0.5) AS obs_p50, any_value(x.mu + y.mu) AS pred_sum, quantile_cont(obs / (x.mu + y.mu), 0.5) AS ratio_p50
FROM o JOIN lv x ON o.a = x.device JOIN lv y ON o.b = y.device GROUP BY a, b""")
def j13(t):
    ep = channel_episodes(t).select(*EP_COLS)
    level = t.channels.where("w > 30").groupBy("device").agg(F.avg("w").alias("mu_w"))
    return PR.pairwise_additivity(ep, t.mains, level, ["house"], min_overlap_s=3600, min_rows=5, bucket_us=4 * HB)


@query("j14_readings_in_episodes", "house:i device:s t_on_us:i peak:d mean_w:d sd_w:d med_w:d n:i", views="channels mains", ctes=CHANNEL_EP, sql="""
SELECT ep.house, ep.device, ep.t_on_us, max(m.w) AS peak, avg(m.w) AS mean_w, stddev_pop(m.w) AS sd_w, quantile_cont(m.w, 0.5) AS med_w, count(*) AS n
FROM ep JOIN mains m ON ep.house = m.house AND m.ts_us BETWEEN ep.t_on_us AND ep.t_off_us GROUP BY 1, 2, 3""")
def j14(t):
    ep = channel_episodes(t).select(*EP_COLS)
    return PR.readings_in(t.mains, ep, ["house"], ["device", "t_on_us"], bucket_us=4 * HB)


PRESS_SQL = """
WITH pr AS (SELECT house, device, ts_us AS press_us FROM channels WHERE w < 12),
c AS (SELECT pr.*, max(CASE WHEN ep.t_on_us < press_us AND ep.t_off_us > press_us THEN 1 ELSE 0 END) AS already, min(CASE WHEN ep.t_on_us >= press_us AND ep.t_on_us - press_us <= 14400000000 THEN ep.t_on_us END) AS nx
 FROM pr LEFT JOIN ep ON pr.house = ep.house AND pr.device = ep.device GROUP BY pr.house, pr.device, press_us),
l AS (SELECT house, device, press_us, CASE WHEN already = 1 THEN 'already_on' WHEN nx IS NOT NULL THEN 'new_activation' ELSE 'uncovered' END AS mode, CASE WHEN already = 1 THEN 0 ELSE (nx - press_us) / 1e6 END AS lat_s FROM c)"""


def presses(t):
    """Low readings stand for logged button presses."""
    return t.channels.where("w < 12").select("house", "device", F.col("ts_us").alias("press_us"))


@query("j15_press_alignment", "house:i device:s press_us:i mode:s lat_s:d", views="channels", ctes=CHANNEL_EP, sql=PRESS_SQL + "SELECT * FROM l")
def j15(t):
    ep = channel_episodes(t).select(*EP_COLS)
    return PR.align_presses(presses(t), ep, ["house", "device"], window_s=14400, chunk_us=CH)


@query("j15_missed_activations", "device:s n:i missed:i", views="channels", ctes=CHANNEL_EP, sql="""
WITH pr AS (SELECT house, device, ts_us AS press_us FROM channels WHERE w < 12)
SELECT device, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM pr WHERE pr.house = ep.house AND pr.device = ep.device AND press_us BETWEEN t_on_us - 14400000000 AND t_on_us + 1800000000)) AS missed FROM ep GROUP BY device""")
def j15_missed(t):
    ep = channel_episodes(t).select(*EP_COLS)
    m = PR.missed_activations(presses(t), ep, ["house", "device"], window_s=14400, grace_s=1800, bucket_us=HB)
    return m.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if("missed").alias("missed"))


@query("j16_cycle_features", "house:i device:s t_on_us:i dp_peak:d gap_max_s:d n_runs:i", views="channels", ctes=CHANNEL_EP, sql="""
WITH r AS (SELECT user_id % 5 AS house, epoch_us(ts) AS t0, value AS dp FROM events WHERE value >= 40),
j AS (SELECT ep.house, ep.device, ep.t_on_us, r.t0, r.dp, (r.t0 - lag(r.t0) OVER (PARTITION BY ep.house, ep.device, ep.t_on_us ORDER BY r.t0)) / 1e6 AS g
 FROM ep JOIN r ON ep.house = r.house AND r.t0 BETWEEN ep.t_on_us - 60000000 AND ep.t_off_us),
f AS (SELECT house, device, t_on_us, max(dp) AS dp_peak, coalesce(max(g), 0) AS gap_max_s, count(*) AS n_runs FROM j GROUP BY 1, 2, 3)
SELECT ep.house, ep.device, ep.t_on_us, dp_peak, coalesce(gap_max_s, 0) AS gap_max_s, coalesce(n_runs, 0) AS n_runs FROM ep LEFT JOIN f ON ep.house = f.house AND ep.device = f.device AND ep.t_on_us = f.t_on_us""")
def j16(t):
    runs = spans(t).where("dp >= 40").select("house", "t0_us", F.col("dp").alias("dp_w"))
    return PR.cycle_features(channel_episodes(t).select(*EP_COLS), runs, ["house"], ["device", "t_on_us"], lead_s=60, bucket_us=4 * HB)


BILL = "bills AS (SELECT o_orderkey, o_orderdate AS d0, o_orderdate + INTERVAL 30 DAY AS d1, o_totalprice FROM orders)"


@query("j17_bill_periods", "o_orderkey:i billed:d metered:d2 n_days:i", ctes=BILL, sql="""
WITH day AS (SELECT l_shipdate AS d, sum(l_extendedprice) / 1000 AS e FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice AS billed, coalesce(sum(e), 0) AS metered, count(d) AS n_days FROM bills LEFT JOIN day ON d >= d0 AND d < d1 GROUP BY 1, 2""")
def j17(t):
    """Metered energy inside [from, from + 30 days); the meter side is summed per day first."""
    day = t.lineitem.groupBy(F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us")).agg((F.sum("l_extendedprice") / 1000).alias("e")).withColumn("k", F.lit(0))
    b = t.orders.select(F.lit(0).alias("k"), "o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("d0"))
    # many bills share a date: sum each distinct period once
    per = b.select("k", "d0").distinct().withColumn("d1", F.col("d0") + 30 * DAY_US)
    s = points_in(day, per, ["k"], start="d0", end="d1", closed="left", bucket_us=30 * DAY_US).groupBy("d0").agg(F.sum("e").alias("metered"), F.count(F.lit(1)).alias("n_days"))
    return b.join(s, "d0", "left").select("o_orderkey", F.col("o_totalprice").alias("billed"), F.coalesce("metered", F.lit(0.0)).alias("metered"), F.coalesce("n_days", F.lit(0)).alias("n_days"))


@query("j18_prorated_overlap", "o_orderkey:i ym:i days:i share:d", ctes=BILL, sql="""
SELECT o_orderkey, CAST(strftime(m, '%Y%m') AS BIGINT) AS ym, date_diff('day', greatest(d0, m), least(d1, m + INTERVAL 1 MONTH)) AS days,
 date_diff('day', greatest(d0, m), least(d1, m + INTERVAL 1 MONTH)) / 30 AS share
FROM (SELECT *, unnest([CAST(date_trunc('month', d0) AS TIMESTAMP), CAST(date_trunc('month', d0) AS TIMESTAMP) + INTERVAL 1 MONTH]) AS m FROM bills) WHERE date_diff('day', greatest(d0, m), least(d1, m + INTERVAL 1 MONTH)) > 0""")
def j18(t):
    d0 = F.to_date("o_orderdate")
    b = t.orders.select("o_orderkey", d0.alias("d0"), F.date_add(d0, 30).alias("d1"))
    m0 = F.trunc("d0", "month")
    x = b.select("*", F.explode(F.array(m0, F.add_months(m0, 1))).alias("m"))
    days = F.datediff(F.least("d1", F.add_months("m", 1)), F.greatest("d0", "m"))
    return x.select("o_orderkey", F.date_format("m", "yyyyMM").cast("bigint").alias("ym"), days.alias("days"), (days / 30).alias("share")).where("days > 0")


@query("j19_monthly_join", "ym:i metered:d2 billed:d2", sql="""
WITH a AS (SELECT CAST(strftime(l_shipdate, '%Y%m') AS BIGINT) AS ym, sum(l_extendedprice) / 1e6 AS metered FROM lineitem GROUP BY 1),
b AS (SELECT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS ym, sum(o_totalprice) / 1e6 AS billed FROM orders GROUP BY 1)
SELECT a.ym, metered, billed FROM a JOIN b ON a.ym = b.ym""")
def j19(t):
    ym = lambda c: F.date_format(c, "yyyyMM").cast("bigint").alias("ym")
    a = t.lineitem.groupBy(ym("l_shipdate")).agg((F.sum("l_extendedprice") / 1e6).alias("metered"))
    return a.join(t.orders.groupBy(ym("o_orderdate")).agg((F.sum("o_totalprice") / 1e6).alias("billed")), "ym")


@query("j20_minute_presence", "house:i n_both:i n_a_only:i n_b_only:i", sql="""
WITH a AS (SELECT DISTINCT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS m FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS m FROM events WHERE event_type = 'view')
SELECT coalesce(a.house, b.house) AS house, count(*) FILTER (a.m IS NOT NULL AND b.m IS NOT NULL) AS n_both, count(*) FILTER (b.m IS NULL) AS n_a_only, count(*) FILTER (a.m IS NULL) AS n_b_only
FROM a FULL OUTER JOIN b ON a.house = b.house AND a.m = b.m GROUP BY 1""")
def j20(t):
    d = t.channels.withColumn("m", bucket_of("ts_us", H))
    s = lambda n: d.where(F.col("device") == n).select("house", "m").distinct()
    a, b = s("click"), s("view")
    both, xa, xb = a.intersect(b), a.subtract(b), b.subtract(a)
    c = lambda x, o: x.groupBy("house").agg(F.count(F.lit(1)).alias(o))
    return c(both, "n_both").join(c(xa, "n_a_only"), "house", "full_outer").join(c(xb, "n_b_only"), "house", "full_outer").fillna(0)


@query("j21_spike_and_settle", "house:i anchor_us:i spike:d settle:d", views="mains", sql="""
WITH d AS (SELECT *, w - lag(w) OVER o AS st, ts_us - lag(ts_us) OVER o AS dt FROM mains WINDOW o AS (PARTITION BY house ORDER BY ts_us, seq)),
a AS (SELECT house, ts_us AS anchor_us FROM d WHERE st BETWEEN 80 AND 400 AND dt <= 7200000000),
s AS (SELECT a.house, anchor_us, max(d.st) AS spike FROM a JOIN d ON a.house = d.house AND d.ts_us > anchor_us - 3600000000 AND d.ts_us <= anchor_us + 3600000000 AND d.dt <= 3600000000 GROUP BY 1, 2),
p AS (SELECT a.house, anchor_us, quantile_cont(CASE WHEN m.ts_us < anchor_us - 600000000 THEN w END, 0.5) AS pre, quantile_cont(CASE WHEN m.ts_us > anchor_us + 600000000 THEN w END, 0.5) AS post FROM a JOIN mains m
 ON a.house = m.house AND m.ts_us >= anchor_us - 7200000000 AND m.ts_us <= anchor_us + 7200000000 GROUP BY 1, 2)
SELECT p.house, p.anchor_us, spike, post - pre AS settle FROM p LEFT JOIN s ON p.house = s.house AND p.anchor_us = s.anchor_us""")
def j21(t):
    """Largest step near an anchor and the level change it leaves."""
    d = X.with_previous(t.mains, ["house"], ["w"]).withColumn("st", F.col("w") - F.col("prev_w"))
    a = d.where("st between 80 and 400 and dt_s <= 7200").select("house", F.col("ts_us").alias("anchor_us"))
    return PR.spike_and_settle(a, d, ["house"], spike_s=3600, near_s=600, far_s=7200, max_dt_s=3600)


@query("j22_anchor_recovery", "house:i n_onsets:i visible:i recovered:i", views="channels mains", sql="""
WITH o AS (SELECT house, ts_us FROM (SELECT *, lag(w) OVER (PARTITION BY house ORDER BY ts_us, seq) AS p FROM channels WHERE device = 'click') WHERE w - p >= 30),
j AS (SELECT house, ts_us FROM (SELECT *, lag(w) OVER (PARTITION BY house ORDER BY ts_us, seq) AS p FROM mains) WHERE w - p >= 40),
v AS (SELECT DISTINCT house, ts_us // 3600000000 AS m FROM channels WHERE device = 'view')
SELECT o.house, count(*) AS n_onsets, count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.house = o.house AND v.m = o.ts_us // 3600000000)) AS visible,
 count(*) FILTER (EXISTS (SELECT 1 FROM j WHERE j.house = o.house AND j.ts_us BETWEEN o.ts_us - 600000000 AND o.ts_us + 600000000)) AS recovered FROM o GROUP BY o.house""")
def j22(t):
    on = X.with_previous(t.channels.where("device = 'click'"), ["house"], ["w"]).where("w - prev_w >= 30").select("house", "ts_us")
    jr = X.with_previous(t.mains, ["house"], ["w"]).where("w - prev_w >= 40").select("house", "ts_us")
    vis = t.channels.where("device = 'view'").select("house", bucket_of("ts_us", H).alias("m")).distinct().withColumn("vis", F.lit(True))
    near = asof_join(on, jr, ["house"], [], tolerance_us=600_000_000, direction="nearest").withColumn("m", bucket_of("ts_us", H))
    j = near.join(vis, ["house", "m"], "left")
    return j.groupBy("house").agg(F.count(F.lit(1)).alias("n_onsets"), F.count_if("vis").alias("visible"), F.count_if(F.col("r_ts_us").isNotNull()).alias("recovered"))


@query("j23_attach_dimensions", "label:s n:i mean_w:d", views="devices", ctes=LABELS_SQL, sql="""
SELECT label, count(*) AS n, avg(w) AS mean_w FROM devices d JOIN labels5 l ON d.device = l.device GROUP BY label""")
def j23(t):
    return t.devices.join(labels5(t), "device").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))


@query("j24_interpolate", "house:i ts_us:i w:d", views="mains", sql="""
WITH s AS (SELECT house, (min(ts_us) + 21599999999) // 21600000000 AS a, max(ts_us) // 21600000000 AS z FROM mains GROUP BY house),
g AS (SELECT house, unnest(generate_series(a, z)) * 21600000000 AS g FROM s),
b AS (SELECT g.house, g.g, m.ts_us AS t0, m.w AS w0 FROM g ASOF JOIN mains m ON g.house = m.house AND g.g >= m.ts_us),
c AS (SELECT b.*, m.ts_us AS t1, m.w AS w1 FROM b ASOF JOIN mains m ON b.house = m.house AND b.g <= m.ts_us)
SELECT house, g AS ts_us, CASE WHEN t1 = t0 THEN w0 ELSE w0 + (w1 - w0) * (g - t0) / (t1 - t0) END AS w FROM c""")
def j24(t):
    """Linear interpolation of the mains on a six-hour grid."""
    b = 6 * H
    s = t.mains.groupBy("house").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    g = s.select("house", F.explode(F.sequence(bucket_of(F.col("a") + b - 1, b), bucket_of("z", b))).alias("g")).select("house", (F.col("g") * b).alias("ts_us"))
    from ..operators.joins import last_before

    m = t.mains.select("house", "ts_us", "w")
    p = last_before(g, m, ["house"], ["w"], prefix="p_")
    p = next_after(p, m, ["house"], ["w"], prefix="n_")
    dx = F.col("n_ts_us") - F.col("p_ts_us")
    return p.select("house", "ts_us", F.when(dx == 0, F.col("p_w")).otherwise(F.col("p_w") + (F.col("n_w") - F.col("p_w")) * (F.col("ts_us") - F.col("p_ts_us")) / dx).alias("w"))
