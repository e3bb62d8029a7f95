"""Queries on drift, contaminated and quiet calibration windows, and press errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import windows as WI
from ..operators.ordered import DAY_US, bucket_of, join_dim
from .catalog import query
from .join_plans import EP_COLS, HB
from .series_plans import CHANNEL_EP, channel_episodes

KEYS = ["house", "device"]


@query("h11_drift", "house:i device:s day:i z:d ewma:d cusum_up:d cusum_down:d alarm:b", views="channels", sql="""
WITH d AS (SELECT house, device, ts_us // 86400000000 AS day, avg(w) AS level FROM channels GROUP BY 1, 2, 3),
f AS (SELECT *, day - min(day) OVER (PARTITION BY house, device) AS age, row_number() OVER (PARTITION BY house, device ORDER BY day) AS n FROM d),
m AS (SELECT house, device, avg(level) AS mu, stddev_samp(level) AS sd FROM f WHERE age < 10 GROUP BY 1, 2),
z AS (SELECT house, device, day, n, (level - mu) / sd AS z FROM f JOIN m USING (house, device) WHERE sd > 0),
walk AS (SELECT house, device, day, n, z, z AS ewma, greatest(0, z - 0.5) AS cusum_up, greatest(0, -z - 0.5) AS cusum_down FROM z WHERE n = 1
 UNION ALL SELECT z.house, z.device, z.day, z.n, z.z, 0.3 * z.z + 0.7 * w.ewma, greatest(0, w.cusum_up + z.z - 0.5), greatest(0, w.cusum_down - z.z - 0.5)
 FROM walk w JOIN z ON z.house = w.house AND z.device = w.device AND z.n = w.n + 1)
SELECT house, device, day, z, ewma, cusum_up, cusum_down, greatest(cusum_up, cusum_down) > 4 AS alarm FROM walk""")
def h11(t):
    """Daily means against the first ten days: a sustained shift raises the sums, a single odd day does not."""
    d = t.channels.groupBy(*KEYS, bucket_of("ts_us", DAY_US).alias("day")).agg(F.avg("w").alias("level"))
    first = d.groupBy(*KEYS).agg(F.min("day").alias("d0"))
    base = join_dim(d, first, KEYS).where("day < d0 + 10").groupBy(*KEYS).agg(F.avg("level").alias("mu"), F.stddev_samp("level").alias("sd")).where("sd > 0")
    z = join_dim(d, base, KEYS).select(*KEYS, "day", ((F.col("level") - F.col("mu")) / F.col("sd")).alias("z"))
    e = D.ewma(z, KEYS, ["day"], "z", 0.3, chunk=bucket_of("day", 7))
    c = D.cusum(e, KEYS, ["day"], "z", chunk=bucket_of("day", 7), slack=0.5)
    return c.withColumn("alarm", F.greatest("cusum_up", "cusum_down") > 4)


EVENTS_SQL = """ev AS (SELECT house, device, t_on_us AS t FROM ep UNION ALL SELECT house, device, t_off_us FROM ep)"""


@query("h12_contamination", "device:s span_h:i n:i raw:i harmful:i n_events:i", views="channels", ctes=CHANNEL_EP + "," + EVENTS_SQL, sql="""
WITH c AS (SELECT ep.device, least((t_off_us - t_on_us) // 3600000000, 3) AS span_h,
 (SELECT count(*) FROM ev WHERE ev.house = ep.house AND ev.device <> ep.device AND ev.t BETWEEN ep.t_on_us - 60000000 AND ep.t_off_us + 60000000) AS a,
 (SELECT count(*) FROM ev WHERE ev.house = ep.house AND ev.device <> ep.device AND ev.t BETWEEN ep.t_on_us - 300000000 AND ep.t_on_us + 300000000) AS b,
 (SELECT count(*) FROM ev WHERE ev.house = ep.house AND ev.device <> ep.device AND ev.t BETWEEN ep.t_off_us - 300000000 AND ep.t_off_us + 300000000) AS z FROM ep)
SELECT device, span_h, count(*) AS n, count(*) FILTER (WHERE a > 0) AS raw, count(*) FILTER (WHERE b + z > 0) AS harmful, sum(a) AS n_events FROM c GROUP BY 1, 2""")
def h12a(t):
    """Windows with any switch event of another device, and with one near their boundaries, by device and window length."""
    c = WI.contamination(channel_episodes(t).select(*EP_COLS), ["house"], pad_s=60, edge_s=300, chunk_us=4 * HB)
    span = F.least(bucket_of(F.col("t_off_us") - F.col("t_on_us"), WI.HOUR_US), F.lit(3)).alias("span_h")
    return c.groupBy("device", span).agg(F.count(F.lit(1)).alias("n"), F.count_if("raw").alias("raw"), F.count_if("harmful").alias("harmful"), F.sum("n_inside").alias("n_events"))


@query("h12_quiet_windows", "house:i hour:i length_s:d share:d", views="channels", ctes=CHANNEL_EP, sql="""
WITH r AS (SELECT house, t_on_us, t_off_us, max(t_off_us) OVER (PARTITION BY house ORDER BY t_on_us, t_off_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ep),
free AS (SELECT house, reach AS t0, t_on_us AS t1 FROM r WHERE reach < t_on_us),
l AS (SELECT unnest([600.0, 3600.0]) AS length_s),
b AS (SELECT house, length_s, t0 AS a, CAST(t1 - length_s * 1000000 AS BIGINT) AS z FROM free, l WHERE t1 - length_s * 1000000 > t0),
bh AS (SELECT house, length_s, h % 24 AS hour, sum(least(z, (h + 1) * 3600000000) - greatest(a, h * 3600000000)) AS us FROM (SELECT *, unnest(range(a // 3600000000, (z - 1) // 3600000000 + 1)) AS h FROM b) GROUP BY 1, 2, 3),
s AS (SELECT house, min(t_on_us) AS a, max(t_off_us) AS z FROM ep GROUP BY house),
sh AS (SELECT house, h % 24 AS hour, sum(least(z, (h + 1) * 3600000000) - greatest(a, h * 3600000000)) AS us FROM (SELECT *, unnest(range(a // 3600000000, (z - 1) // 3600000000 + 1)) AS h FROM s) GROUP BY 1, 2)
SELECT sh.house, sh.hour, l.length_s, coalesce(bh.us, 0) / sh.us AS share FROM sh CROSS JOIN l LEFT JOIN bh ON bh.house = sh.house AND bh.hour = sh.hour AND bh.length_s = l.length_s""")
def h12q(t):
    """Share of clock time, by hour of day, at which a quiet window of ten minutes or an hour could begin."""
    return WI.quiet_share(channel_episodes(t).select(*EP_COLS), ["house"], [600.0, 3600.0])


ERRORS_S = (0, 600, 1800, 3600, 7200, 14400)  # sizes of the press error; its sign is drawn by hash


@query("h10_press_jitter", "device:s error_s:i n:i n_off:i mae_off:d n_on:i mae_on:d", views="channels mains", ctes=CHANNEL_EP, sql="""
WITH e AS (SELECT house, device, t_on_us, t_off_us, error_s, t_on_us + CAST(error_s AS BIGINT) * 1000000 * CASE WHEN ('0x' || left(md5(house || ':' || device || ':' || t_on_us || ':' || error_s), 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS p
 FROM ep, (SELECT unnest([0, 600, 1800, 3600, 7200, 14400]) AS error_s)),
s0 AS (SELECT house, ts_us, w, avg(w) OVER f AS fw, avg(w) OVER b AS bw, count(w) OVER f AS fn, count(w) OVER b AS bn FROM mains WINDOW f AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), b AS (PARTITION BY house ORDER BY ts_us, seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
st AS (SELECT house, ts_us, fw - bw AS size FROM s0 WHERE fn = 2 AND bn = 2 AND fw > bw),
sn AS (SELECT e.house, e.device, e.t_on_us, e.error_s, min_by(st.ts_us, (-round(size, 9), abs(st.ts_us - p), st.ts_us)) AS s FROM e JOIN st ON st.house = e.house AND st.ts_us BETWEEN p - 5400000000 AND p + 5400000000 GROUP BY 1, 2, 3, 4),
v AS (SELECT e.*, coalesce(s, p) AS q FROM e LEFT JOIN sn USING (house, device, t_on_us, error_s)),
lv AS (SELECT v.house, v.device, v.t_on_us, v.error_s,
 avg(w) FILTER (ts_us >= v.t_on_us AND ts_us < t_off_us) - avg(w) FILTER (ts_us >= v.t_on_us - 7200000000 AND ts_us < v.t_on_us) AS l0,
 avg(w) FILTER (ts_us >= p AND ts_us < t_off_us) - avg(w) FILTER (ts_us >= p - 7200000000 AND ts_us < p AND ts_us < t_off_us) AS l1,
 avg(w) FILTER (ts_us >= q AND ts_us < t_off_us) - avg(w) FILTER (ts_us >= q - 7200000000 AND ts_us < q AND ts_us < t_off_us) AS l2
 FROM v JOIN mains m ON m.house = v.house AND m.ts_us BETWEEN v.t_on_us - 30000000000 AND v.t_off_us GROUP BY ALL)
SELECT device, error_s, count(*) AS n, count(l1 - l0) AS n_off, avg(abs(l1 - l0)) AS mae_off, count(l2 - l0) AS n_on, avg(abs(l2 - l0)) AS mae_on FROM lv GROUP BY 1, 2""")
def h10(t):
    """Error of the level learned from one press against the size of the press error, as pressed and snapped to the largest rise near it."""
    ep = channel_episodes(t).select(*EP_COLS).withColumn("error_s", F.explode(F.array(*[F.lit(x) for x in ERRORS_S])))
    name = F.concat_ws(":", "house", "device", "t_on_us", "error_s")
    sign = F.when(F.conv(F.substring(F.md5(name.cast("binary")), 1, 2), 16, 10).cast("bigint") % 2 == 0, 1).otherwise(-1)
    ep = ep.withColumn("p", F.col("t_on_us") + F.col("error_s").cast("bigint") * 1_000_000 * sign)
    ident = ["device", "t_on_us", "error_s"]
    ep = WI.snap_to_step(ep, t.mains, ["house"], ident, at="p", within_s=5400, rows=2, bucket_us=4 * HB, out="q")
    for start, out in (("t_on_us", "l0"), ("p", "l1"), ("q", "l2")):
        marks = ep if start != "t_on_us" else ep.withColumn("_start", F.col("t_on_us"))
        ep = WI.level_between(marks, t.mains, ["house"], ident, start="_start" if start == "t_on_us" else start, end="t_off_us", base_s=7200, bucket_us=4 * HB, out=out)
    err = lambda c: F.abs(F.col(c) - F.col("l0"))
    return ep.groupBy("device", "error_s").agg(F.count(F.lit(1)).alias("n"), F.count(err("l1")).alias("n_off"), F.avg(err("l1")).alias("mae_off"), F.count(err("l2")).alias("n_on"), F.avg(err("l2")).alias("mae_on"))
