"""Queries on inventories, audits, tiers and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import episodes as X
from ..operators import stats as ST
from ..operators.joins import overlap_join
from ..operators.ordered import DAY_US, bucket_of, islands, join_dim, ordered_scan
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..sources import audit as AU
from .catalog import query
from .series_plans import CH, CHANNEL_EP, H, channel_episodes
from .stats_plans import BATTERY, DT_DEV

# five stand-in labels for the five event types
LABELS = (("click", "Kettle-Radio"), ("view", "fridge_freezer"), ("error", "Washing  Machine"), ("signup", "tv"), ("purchase", "microwave"))
LABELS_SQL = "labels5(device, label) AS (VALUES " + ", ".join(f"('{d}', '{v}')" for d, v in LABELS) + ")"


def labels5(t):
    return F.broadcast(t.spark.createDataFrame(list(LABELS), "device string, label string"))  # five literal rows


@query("a21_event_simultaneity", "device:s n:i busy:i top_partner:s top_n:i", views="channels", ctes=CHANNEL_EP, sql="""
WITH p AS (SELECT a.house, a.device, a.t_on_us, b.device AS other FROM ep a JOIN ep b ON a.house = b.house AND a.device <> b.device AND b.t_on_us <= a.t_on_us AND b.t_off_us >= a.t_on_us),
c AS (SELECT device, other, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT device, min_by(other, (-n, other)) AS top_partner, max(n) AS top_n FROM c GROUP BY device),
u AS (SELECT device, count(*) AS busy FROM (SELECT DISTINCT house, device, t_on_us FROM p) GROUP BY device)
SELECT e.device, count(*) AS n, any_value(busy) AS busy, any_value(top_partner) AS top_partner, any_value(top_n) AS top_n FROM ep e LEFT JOIN t ON e.device = t.device LEFT JOIN u ON e.device = u.device GROUP BY e.device""")
def a21(t):
    ep = channel_episodes(t).select("house", "device", "t_on_us", "t_off_us")
    pts = ep.withColumn("t_end", F.col("t_on_us"))
    p = overlap_join(pts, ep, ["house"], left_span=("t_on_us", "t_end"), right_span=("t_on_us", "t_off_us"), touch=True,
                     extra=F.col("l.device") != F.col("r.device"))
    p = p.select("house", F.col("l.device").alias("device"), F.col("l.t_on_us").alias("t_on_us"), F.col("r.device").alias("other"))
    c = p.groupBy("device", "other").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("device").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("top_partner"), F.max("n").alias("top_n"))
    busy = p.select("house", "device", "t_on_us").distinct().groupBy("device").agg(F.count(F.lit(1)).alias("busy"))
    n = ep.groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    return n.join(busy, "device", "left").join(top, "device", "left")


@query("a41_draw_reduction", "k:i n_rows:i f_mean:d f_std:d f_med:d", sql="""
SELECT l_linenumber AS k, count(*) AS n_rows, avg(l_discount) AS f_mean, stddev_pop(l_discount) AS f_std, quantile_cont(l_tax, 0.5) AS f_med FROM lineitem GROUP BY 1""")
def a41(t):
    """Mean, population deviation and median of the draws of each K."""
    d = t.lineitem.withColumn("k", F.col("l_linenumber"))
    g = d.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("l_discount").alias("f_mean"), F.stddev_pop("l_discount").alias("f_std"))
    return g.join(exact_quantiles(d, ["k"], {"f_med": ("l_tax", 0.5)}), "k")


@query("a42_confusion", "true_label:s click:i view:i other:i accuracy:d", sql="""
WITH x AS (SELECT event_type AS true_label, CASE WHEN value > 80 THEN 'click' WHEN value > 30 THEN 'view' ELSE 'other' END AS pred FROM events)
SELECT true_label, count(*) FILTER (pred = 'click') AS click, count(*) FILTER (pred = 'view') AS view, count(*) FILTER (pred = 'other') AS other,
 avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM x GROUP BY true_label""")
def a42(t):
    pred = F.when(F.col("w") > 80, "click").when(F.col("w") > 30, "view").otherwise("other")
    x = t.devices.select(F.col("device").alias("true_label"), pred.alias("pred"))
    p = x.groupBy("true_label").pivot("pred", ["click", "view", "other"]).count().fillna(0)
    acc = x.groupBy("true_label").agg(F.avg((F.col("pred") == F.col("true_label")).cast("int")).alias("accuracy"))
    return p.join(acc, "true_label")


@query("a43_inventory", "house:s click:i view:i error:i signup:i purchase:i total:i", sql="""
SELECT coalesce(CAST(user_id % 5 AS VARCHAR), 'all') AS house, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
 count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS total FROM events GROUP BY ROLLUP (user_id % 5)""")
def a43(t):
    """Building x type counts with a totals row."""
    names = ["click", "view", "error", "signup", "purchase"]
    c = t.channels.rollup("house").agg(*[F.count_if(F.col("device") == n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))
    return c.withColumn("house", F.coalesce(F.col("house").cast("string"), F.lit("all")))


@query("a44_dead_by_energy", "meter:i kwh:d dead:b", views="readings", sql="""
SELECT meter, coalesce(sum(w * least(coalesce(nx - ts_us, 0), 600000000)), 0) / 3.6e12 AS kwh, coalesce(sum(w * least(coalesce(nx - ts_us, 0), 600000000)), 0) / 3.6e12 < 0.5 AS dead
FROM (SELECT *, lead(ts_us) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS nx FROM readings) GROUP BY meter""")
def a44_energy(t):
    """Meters that used less than half a kilowatt hour over the whole span."""
    return ST.dead_by_energy(t.readings, ["meter"], max_hold_s=600, chunk_us=CH)


@query("a44_activity_tiers", "meter:i n:i finite_share:d tier:s unplugged:b stalled:b", views="readings", sql="""
WITH e AS (SELECT max(ts_us) AS t1 FROM readings),
a AS (SELECT meter, count(*) AS n, avg(CASE WHEN w >= 10 THEN 1.0 ELSE 0.0 END) AS fs, sum(w) AS sw, max(ts_us) AS tl, min(ts_us) AS t0,
 max(c) / count(*) AS pin FROM (SELECT *, count(*) OVER (PARTITION BY meter, floor(w / 10)) AS c FROM readings) GROUP BY meter)
SELECT meter, n, fs AS finite_share, CASE WHEN fs = 0 THEN 'dead' WHEN fs < 0.7 THEN 'zombie' WHEN fs < 0.75 THEN 'thin' WHEN fs < 0.8 THEN 'partial' ELSE 'steady' END AS tier,
 t0 < t1 - 20 * 86400000000 AND tl < t1 - 86400000000 AS unplugged, pin > 0.2 AS stalled FROM a, e""")
def a44(t):
    r = t.readings
    end = r.agg(F.max("ts_us").alias("t1"))
    pin = r.groupBy("meter", F.floor(F.col("w") / 10).alias("b")).agg(F.count(F.lit(1)).alias("c")).groupBy("meter").agg(F.max("c").alias("cmax"))
    a = r.groupBy("meter").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("w") >= 10).cast("int")).alias("finite_share"), F.max("ts_us").alias("tl"), F.min("ts_us").alias("t0"))
    fs = F.col("finite_share")
    tier = F.when(fs == 0, "dead").when(fs < 0.7, "zombie").when(fs < 0.75, "thin").when(fs < 0.8, "partial").otherwise("steady")
    return (a.join(pin, "meter").crossJoin(F.broadcast(end))  # one row
            .select("meter", "n", "finite_share", tier.alias("tier"), ((F.col("t0") < F.col("t1") - 20 * DAY_US) & (F.col("tl") < F.col("t1") - DAY_US)).alias("unplugged"),
                    (F.col("cmax") / F.col("n") > 0.2).alias("stalled")))


@query("a45_physics_verdicts", "device:s label:s verdict:s plausible:s", views="devices", ctes=LABELS_SQL + "," + DT_DEV + "," + BATTERY, sql="""
WITH v AS (SELECT b.device, label, CASE WHEN n = 0 THEN 'EMPTY' WHEN vmax < 100 THEN 'NEAR-DEAD' WHEN p50_on_w >= 1000 THEN 'HEATER'
 WHEN on_share BETWEEN 0.08 AND 0.60 AND p50_on_w >= 30 AND p50_on_w < 1000 AND episodes_per_day >= 1 THEN 'COMPRESSOR' WHEN vmax >= 1500 AND on_share < 0.08 THEN 'EPISODIC-HIGH'
 WHEN on_share > 0.60 AND p50_on_w < 100 THEN 'STANDBY-PLATEAU' WHEN p50_on_w < 20 THEN 'TRICKLE' ELSE 'WEAK' END AS verdict FROM battery b JOIN labels5 l ON b.device = l.device)
SELECT device, label, verdict, CASE WHEN regexp_matches(lower(label), 'kettle|microwave|iron|toaster|hair dryer|space heater|spin dryer|coffee|oven|washing machine|dish washer|dishwasher')
 THEN CASE WHEN verdict IN ('HEATER', 'EPISODIC-HIGH') THEN 'yes' ELSE 'NO' END
 WHEN regexp_matches(lower(label), 'fridge|freezer|refrigerat|air handling|ventilation') THEN CASE WHEN verdict = 'COMPRESSOR' THEN 'yes' ELSE 'NO' END
 ELSE CASE WHEN verdict IN ('TRICKLE', 'STANDBY-PLATEAU', 'WEAK') THEN 'yes' ELSE 'NO' END END AS plausible FROM v""")
def a45(t):
    b = ST.channel_battery(t.devices, ["device"]).join(labels5(t), "device")
    st = {c: F.col(c) for c in ("on_share", "p50_on_w", "vmax", "episodes_per_day", "n")} | {"n_all": F.col("n")}
    b = b.withColumn("verdict", ST.physics_verdict(st)).withColumn("exp", ST.expected_verdicts(F.col("label")))
    ok = F.when(F.col("exp").isNull(), "-").when(F.array_contains("exp", F.col("verdict")), "yes").otherwise("NO")
    return b.select("device", "label", "verdict", ok.alias("plausible"))


@query("a46_column_audit", "col:s n:i missing:i junk:i n_distinct_junk:i sample:s", sql="""
WITH u AS (SELECT 'event_type' AS col, event_type AS v FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events
 UNION ALL SELECT 'mixed', CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END FROM events)
SELECT col, count(*) AS n, count(*) FILTER (v IS NULL OR trim(v) = '') AS missing, count(*) FILTER (trim(v) <> '' AND TRY_CAST(trim(v) AS DOUBLE) IS NULL) AS junk,
 count(DISTINCT CASE WHEN trim(v) <> '' AND TRY_CAST(trim(v) AS DOUBLE) IS NULL THEN trim(v) END) AS n_distinct_junk,
 min(CASE WHEN trim(v) <> '' AND TRY_CAST(trim(v) AS DOUBLE) IS NULL THEN trim(v) END) AS sample FROM u GROUP BY col""")
def a46(t):
    e = t.events
    mixed = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    d = e.select("event_type", F.col("value").cast("string").alias("value"), mixed.alias("mixed"))
    return AU.column_audit(d, ["event_type", "value", "mixed"]).withColumn("sample", F.col("samples")[0])


@query("a47_order_audit", "n:i n_dup:i n_decreasing:i all_null:s", sql="""
WITH a AS (SELECT *, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)
SELECT count(*) AS n, count(*) FILTER (o_orderdate = p) AS n_dup, count(*) FILTER (o_orderdate < p) AS n_decreasing, '' AS all_null FROM a""")
def a47(t):
    d = t.orders.select(F.lit(0).alias("k"), F.col("o_orderkey").alias("idx"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"), "o_custkey", "o_orderstatus")
    return AU.order_audit(d, ["k"], "idx", "ts_us", ["o_custkey", "o_orderstatus"], rows_per_chunk=4096)


@query("a49_layer_reconciliation", "house:i rows_match:b ends_match:b sum_diff:d violation:b", views="mains channels", sql="""
WITH a AS (SELECT house, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1, sum(w) AS s FROM mains GROUP BY house),
b AS (SELECT house, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1, sum(w) AS s FROM channels GROUP BY house)
SELECT a.house, a.n = b.n AS rows_match, a.t0 = b.t0 AND a.t1 = b.t1 AS ends_match, abs(a.s - b.s) AS sum_diff, a.n <> b.n OR a.t0 <> b.t0 OR a.t1 <> b.t1 OR abs(a.s - b.s) > 1e-6 AS violation FROM a JOIN b ON a.house = b.house""")
def a49(t):
    return AU.reconcile(AU.layer_profile(t.mains, ["house"]), AU.layer_profile(t.channels, ["house"]), ["house"])


@query("a50_minute_coverage", "house:i minutes:i coverage:d longest_missing:i occupied:d", views="mains", sql="""
WITH m AS (SELECT house, count(DISTINCT ts_us // 60000000) AS minutes, (max(ts_us) // 60000000 - min(ts_us) // 60000000 + 1) AS span FROM mains GROUP BY house),
a AS (SELECT *, CASE WHEN w < 10 THEN 1 ELSE 0 END AS ms FROM mains),
b AS (SELECT *, CASE WHEN ms = lag(ms) OVER (PARTITION BY house ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us, seq) AS rid FROM b),
r AS (SELECT house, max(n) AS longest_missing FROM (SELECT house, rid, count(*) AS n FROM c WHERE ms = 1 GROUP BY house, rid) GROUP BY house),
o AS (SELECT house, avg(CASE WHEN ms = 0 THEN 1.0 ELSE 0.0 END) AS occupied FROM a GROUP BY house)
SELECT m.house, minutes, minutes / span AS coverage, longest_missing, occupied FROM m JOIN r ON m.house = r.house JOIN o ON m.house = o.house""")
def a50(t):
    m = t.mains
    mins = m.select("house", bucket_of("ts_us", 60_000_000).alias("mi")).distinct().groupBy("house").agg(
        F.count(F.lit(1)).alias("minutes"), (F.max("mi") - F.min("mi") + 1).alias("span"))
    miss = X.state_runs(m, ["house"], X.on_mark(F.col("w") < 10)).where("state = 1").groupBy("house").agg(F.max("n_rows").alias("longest_missing"))
    occ = m.groupBy("house").agg(F.avg((~(F.col("w") < 10)).cast("int")).alias("occupied"))
    return mins.join(miss, "house").join(occ, "house").withColumn("coverage", F.col("minutes") / F.col("span"))


@query("a51_occupied_vs_away", "house:i hr:i occ_w:d away_w:d", sql="""
WITH o AS (SELECT DISTINCT user_id % 5 AS house, epoch_us(ts) // 7200000000 AS b FROM events WHERE event_type = 'signup')
SELECT e.user_id % 5 AS house, (epoch_us(e.ts) // 3600000000) % 24 AS hr, avg(CASE WHEN o.b IS NOT NULL THEN e.value END) AS occ_w, avg(CASE WHEN o.b IS NULL THEN e.value END) AS away_w
FROM events e LEFT JOIN o ON o.house = e.user_id % 5 AND o.b = epoch_us(e.ts) // 7200000000 GROUP BY 1, 2""")
def a51(t):
    b = bucket_of("ts_us", 2 * H).alias("b")
    occ = t.channels.where("device = 'signup'").select("house", b).distinct().withColumn("occ", F.lit(True))
    d = t.mains.select("*", b).join(occ, ["house", "b"], "left")
    return d.groupBy("house", F.pmod(bucket_of("ts_us", H), F.lit(24)).alias("hr")).agg(
        F.avg(F.when(F.col("occ"), F.col("w"))).alias("occ_w"), F.avg(F.when(F.col("occ").isNull(), F.col("w"))).alias("away_w"))


@query("a52_bill_closure", "status:s n:i max_gap:d2 dup_anchors:i over_tier:i", sql="""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice * l_discount) AS disc, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1)
SELECT o_orderstatus AS status, count(*) AS n, max(abs(gross - net - disc)) AS max_gap, count(*) - count(DISTINCT o_orderdate) AS dup_anchors, count(*) FILTER (gross / 30 > 5000) AS over_tier
FROM orders o JOIN l ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def a52(t):
    li = t.lineitem
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    b = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(p * (1 - d)).alias("net"), F.sum(p * d).alias("disc"), F.sum(p).alias("gross"))
    j = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate").join(b, "o_orderkey")
    s = j.groupBy("o_orderstatus", "o_orderdate").agg(F.count(F.lit(1)).alias("c"), F.max(F.abs(F.col("gross") - F.col("net") - F.col("disc"))).alias("g"),
                                                      F.count_if(F.col("gross") / 30 > 5000).alias("o"))
    return s.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum("c").alias("n"), F.max("g").alias("max_gap"), (F.sum("c") - F.count(F.lit(1))).alias("dup_anchors"),
                                                                 F.sum("o").alias("over_tier"))


@query("a53_flag_audit", "flag:s null_n:i n:i blocks:i longest:i agree_a:i agree_b:i", sql="""
WITH a AS (SELECT event_id AS seq, ts, CASE WHEN value > 100 THEN 'high' ELSE 'ok' END AS flag, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v,
  strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS kept FROM events),
b AS (SELECT *, CASE WHEN flag = lag(flag) OVER (ORDER BY ts, seq) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (ORDER BY ts, seq) AS rid FROM b),
r AS (SELECT flag, count(*) AS blocks, max(n) AS longest FROM (SELECT flag, rid, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY flag)
SELECT a.flag, count(*) FILTER (v IS NULL) AS null_n, count(*) AS n, any_value(blocks) AS blocks, any_value(longest) AS longest,
 count(*) FILTER (kept = strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H')) AS agree_a, count(*) FILTER (kept = strftime(ts, '%Y-%m-%d %H')) AS agree_b FROM a JOIN r ON a.flag = r.flag GROUP BY a.flag""")
def a53(t):
    """Flag x null counts, flagged blocks, and which zone a kept local hour string fits."""
    d = t.mains.select(F.lit(0).alias("k"), "ts_us", "seq", F.when(F.col("w") > 100, "high").otherwise("ok").alias("flag"), F.when(F.col("seq") % 13 == 0, None).otherwise(F.col("w")).alias("w"))
    loc = lambda z: F.date_format(F.from_utc_timestamp(F.timestamp_micros("ts_us"), z), "yyyy-MM-dd HH")
    kept = F.date_format(F.timestamp_micros(F.col("ts_us") + H), "yyyy-MM-dd HH")
    g = d.groupBy("flag").agg(F.count_if(F.col("w").isNull()).alias("null_n"), F.count(F.lit(1)).alias("n"), F.count_if(kept == loc("Europe/Vienna")).alias("agree_a"),
                              F.count_if(kept == loc("UTC")).alias("agree_b"))
    r = islands(d, ["k"], ["ts_us", "seq"], bucket_of("ts_us", DAY_US), row={"flag": "flag"}, breaks=lambda p, c: p["flag"] != c["flag"])
    b = r.groupBy(F.col("first.flag").alias("flag")).agg(F.count(F.lit(1)).alias("blocks"), F.max("n_rows").alias("longest"))
    return g.join(b, "flag")


@query("a54_cycle_durations", "device:s n:i p10:d p50:d p90:d long_share:d", views="channels", ctes=CHANNEL_EP, sql="""
SELECT device, count(*) AS n, quantile_cont(dur_s, 0.1) AS p10, quantile_cont(dur_s, 0.5) AS p50, quantile_cont(dur_s, 0.9) AS p90, avg(CASE WHEN dur_s > 43200 THEN 1.0 ELSE 0.0 END) AS long_share FROM ep GROUP BY device""")
def a54(t):
    ep = channel_episodes(t)
    q = exact_quantiles(ep, ["device"], {"p10": ("dur_s", 0.1), "p50": ("dur_s", 0.5), "p90": ("dur_s", 0.9)}, {"n": "dur_s"})
    return q.join(ep.groupBy("device").agg(F.avg((F.col("dur_s") > 43200).cast("int")).alias("long_share")), "device")


@query("a55_store_census", "house:i device:s n:i dur_p50:d energy_p50:d tags:s", views="channels", ctes=CHANNEL_EP, sql="""
SELECT house, device, count(*) AS n, quantile_cont(dur_s, 0.5) AS dur_p50, quantile_cont(energy_wh, 0.5) AS energy_p50,
 CASE WHEN bool_or(dur_s > 43200) AND bool_or(dur_s <= 43200) THEN 'rule_long,rule_short' WHEN bool_or(dur_s > 43200) THEN 'rule_long' ELSE 'rule_short' END AS tags FROM ep GROUP BY 1, 2""")
def a55(t):
    ep = channel_episodes(t).withColumn("source", F.when(F.col("dur_s") > 43200, "rule_long").otherwise("rule_short"))
    q = exact_quantiles(ep, ["house", "device"], {"dur_p50": ("dur_s", 0.5), "energy_p50": ("energy_wh", 0.5)}, {"n": "dur_s"})
    tags = ep.groupBy("house", "device").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("tags"))
    return q.join(tags, ["house", "device"])


@query("a56_class_house_matrix", "device:s h0:i h1:i h2:i h3:i h4:i n_houses:i", sql="""
SELECT event_type AS device, """ + ", ".join(f"count(DISTINCT CASE WHEN user_id % 5 = {h} THEN user_id END) AS h{h}" for h in range(5)) + """, count(DISTINCT user_id % 5) AS n_houses FROM events GROUP BY 1""")
def a56(t):
    u = t.events.select(F.col("event_type").alias("device"), "user_id").distinct().withColumn("house", F.col("user_id") % 5)
    p = u.groupBy("device").pivot("house", [0, 1, 2, 3, 4]).count().fillna(0)
    n = u.select("device", "house").distinct().groupBy("device").agg(F.count(F.lit(1)).alias("n_houses"))
    return p.join(n, "device").select("device", *[F.col(str(h)).alias(f"h{h}") for h in range(5)], "n_houses")


@query("a57_threshold_transfer", "device:s n_channels:i fleet_p50:d n_low:i", views="channels", sql="""
WITH c AS (SELECT house, device, 0.5 * quantile_cont(CASE WHEN w > 5 THEN w END, 0.5) AS thr FROM channels GROUP BY 1, 2),
f AS (SELECT device, quantile_cont(thr, 0.5) AS p50 FROM c GROUP BY device)
SELECT c.device, count(*) AS n_channels, any_value(p50) AS fleet_p50, count(*) FILTER (thr < p50 * 0.98) AS n_low FROM c JOIN f ON c.device = f.device GROUP BY c.device""")
def a57(t):
    """Channels under 98 % of the fleet median (half of it on real fleets)."""
    c = exact_quantiles(t.channels.withColumn("ab", F.when(F.col("w") > 5, F.col("w"))), ["house", "device"], {"p": ("ab", 0.5)})
    c = with_quantiles(c.withColumn("thr", 0.5 * F.col("p")), ["device"], {"fleet_p50": ("thr", 0.5)})
    return c.groupBy("device").agg(F.count(F.lit(1)).alias("n_channels"), F.max("fleet_p50").alias("fleet_p50"), F.count_if(F.col("thr") < F.col("fleet_p50") * 0.98).alias("n_low"))


@query("a58_fleet_freezes", "win:i n_meters:i n_frozen:i longest_rows:i", sql="""
WITH a AS (SELECT user_id AS meter, epoch_us(ts) AS ts_us, event_id AS seq, floor(value / 60) AS w FROM events),
b AS (SELECT *, CASE WHEN w = lag(w) OVER (PARTITION BY meter ORDER BY ts_us, seq) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY meter ORDER BY ts_us, seq) AS rid FROM b),
d AS (SELECT *, count(*) OVER (PARTITION BY meter, rid) AS n FROM c),
m AS (SELECT ts_us // 172800000000 AS win, meter, avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END) AS fz, max(CASE WHEN n >= 3 THEN n ELSE 0 END) AS ln FROM d GROUP BY 1, 2)
SELECT win, count(*) AS n_meters, count(*) FILTER (fz > 0.9) AS n_frozen, max(ln) AS longest_rows FROM m GROUP BY win""")
def a58(t):
    """Meters frozen for over 90 % of each window; runs are spread over the windows they touch."""
    d = t.readings.withColumn("w", F.floor(F.col("w") / 60).cast("double"))
    runs = X.frozen_runs(d, ["meter"], 0.0, 1.0, chunk_us=CH).where("n_rows >= 3").select("meter", "t0_us", "t1_us", "n_rows")
    from ..operators.joins import points_in

    win = bucket_of("ts_us", 2 * DAY_US)
    hit = points_in(d.select("meter", "ts_us"), runs, ["meter"], start="t0_us", end="t1_us", bucket_us=CH)
    f = hit.groupBy("meter", win.alias("win")).agg(F.count(F.lit(1)).alias("nf"), F.max("n_rows").alias("ln"))
    n = d.groupBy("meter", win.alias("win")).agg(F.count(F.lit(1)).alias("n"))
    j = n.join(f, ["meter", "win"], "left").fillna(0, ["nf", "ln"])
    return j.groupBy("win").agg(F.count(F.lit(1)).alias("n_meters"), F.count_if(F.col("nf") / F.col("n") > 0.9).alias("n_frozen"), F.max("ln").alias("longest_rows"))


@query("a59_reporting_columns", "k:i n_stamps:i", sql="""
SELECT k, count(*) AS n_stamps FROM (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 AS hr, count(DISTINCT event_type) AS k FROM events GROUP BY 1, 2) GROUP BY k""")
def a59(t):
    c = t.channels.select("house", bucket_of("ts_us", H).alias("hr"), "device").distinct()
    return c.groupBy("house", "hr").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_stamps"))


@query("a59_column_report", "house:i device:s report_rate:d observed_s:d", views="channels", sql="""
WITH g AS (SELECT *, (lead(ts_us) OVER (PARTITION BY house, device ORDER BY ts_us, seq) - ts_us) / 1e6 AS dt FROM channels),
s AS (SELECT house, count(*) AS n FROM channels GROUP BY house)
SELECT g.house, device, count(*) / any_value(n) AS report_rate, sum(least(coalesce(dt, 0), 3600)) AS observed_s FROM g JOIN s ON g.house = s.house GROUP BY 1, 2""")
def a59_report(t):
    g = X.gaps(t.channels, ["house", "device"], chunk_us=CH, keep_last=True)
    s = g.groupBy("house", "device").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.coalesce("dt_s", F.lit(0.0)), F.lit(3600.0))).alias("observed_s"))
    return s.withColumn("report_rate", F.col("n") / F.sum("n").over(W.partitionBy("house")))


@query("a60_dataset_summary", "house:i rows:i span_d:d kwh:d per_device:s", views="channels", sql="""
WITH d AS (SELECT house, device, count(*) AS n FROM channels GROUP BY 1, 2),
j AS (SELECT house, string_agg(device || '=' || n, ';' ORDER BY device) AS per_device FROM d GROUP BY house)
SELECT c.house, count(*) AS rows, (max(ts_us) - min(ts_us)) / 86400e6 AS span_d, sum(w) / 1000 AS kwh, any_value(per_device) AS per_device FROM channels c JOIN j ON c.house = j.house GROUP BY c.house""")
def a60(t):
    d = t.channels.groupBy("house", "device").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z"), F.sum("w").alias("s"))
    item = F.sort_array(F.collect_list(F.struct("device", "n")))  # one entry per device type of a house
    return d.groupBy("house").agg(F.sum("n").alias("rows"), ((F.max("z") - F.min("a")) / 86400e6).alias("span_d"), (F.sum("s") / 1000).alias("kwh"),
                                  F.array_join(F.transform(item, lambda x: F.concat_ws("=", x["device"], x["n"].cast("string"))), ";").alias("per_device"))
