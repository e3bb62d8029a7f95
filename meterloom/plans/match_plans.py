"""Queries that match detections with truth and score them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import episodes as X
from ..operators import matching as M
from ..operators import profiles as PR
from ..operators.joins import overlap_flag, points_in
from ..operators.ordered import DAY_US, bucket_of, join_dim, ordered_scan
from ..operators.quantiles import exact_quantiles
from ..operators.stats import prf
from ..session import cut_lineage
from .catalog import query
from .join_plans import EP_COLS, HB
from .series_plans import CH, CHANNEL_EP, DWELL_S, H, HOLD_S, MERGE_S, channel_episodes, episodes_sql, hyst_sql

TAU = 1_800_000_000
KEYS = ["house", "device"]

# truth = threshold episodes, prediction = a hysteresis detector at 40 W on the same channel
PRED_SQL = (hyst_sql("channels", "house, device", "w > 40", "w < 36", n="hp") + "," + episodes_sql("hp_b", "house, device", "on_state = 1", name="pr"))
TP_CTES = CHANNEL_EP + "," + PRED_SQL

# two-pointer greedy as a recursive walk over both lists of a channel
MATCH_SQL = f"""
g AS (SELECT house, device, t_on_us, t_off_us, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS i FROM ep),
p AS (SELECT house, device, t_on_us, t_off_us, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS j FROM pr),
walk(house, device, i, j, gi, pj) AS (
 SELECT DISTINCT house, device, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM g
 UNION ALL
 SELECT m.house, m.device, CASE WHEN p.t_on_us < g.t_on_us - {TAU} THEN m.i ELSE m.i + 1 END, CASE WHEN p.t_on_us > g.t_on_us + {TAU} THEN m.j ELSE m.j + 1 END,
  CASE WHEN abs(p.t_on_us - g.t_on_us) <= {TAU} THEN m.i END, CASE WHEN abs(p.t_on_us - g.t_on_us) <= {TAU} THEN m.j END
 FROM walk m JOIN g ON g.house = m.house AND g.device = m.device AND g.i = m.i JOIN p ON p.house = m.house AND p.device = m.device AND p.j = m.j),
mt AS (SELECT w.house, w.device, gi AS g_id, pj AS p_id, g.t_on_us AS g_on, g.t_off_us AS g_off, p.t_on_us AS p_on, p.t_off_us AS p_off FROM walk w
 JOIN g ON g.house = w.house AND g.device = w.device AND g.i = w.gi JOIN p ON p.house = w.house AND p.device = w.device AND p.j = w.pj),
mk AS (SELECT *, (p_on - g_on) / 1e6 AS onset_err_s, (p_off - g_off) / 1e6 AS offset_err_s, (p_off - p_on) / greatest(g_off - g_on, 1) AS dur_ratio,
 greatest(0, least(p_off, g_off) - greatest(p_on, g_on)) / greatest((p_off - p_on) + (g_off - g_on) - greatest(0, least(p_off, g_off) - greatest(p_on, g_on)), 1) AS iou FROM mt
 WHERE (p_off - p_on) / greatest(g_off - g_on, 1) BETWEEN 1.0 / 3 AND 3)"""
REC = "WITH RECURSIVE "


def rec(sql_ctes, tail):
    """A body whose leading WITH the catalog can splice."""
    return f"WITH {sql_ctes.strip()} {tail}"


def truth_pred(t):
    pred = X.anchor_episodes(t.channels, KEYS, 40.0, min_dwell_s=DWELL_S, merge_gap_s=MERGE_S, hold_s=HOLD_S, chunk_us=CH)
    return cut_lineage(channel_episodes(t).select(*EP_COLS)), cut_lineage(pred.select(*EP_COLS))  # matched and counted


def matched(t, band=True):
    g, p = truth_pred(t)
    m = M.match_onsets(g, p, KEYS, TAU, chunk_us=CH)
    return g, p, (m.where(M.in_dwell_band()) if band else m)


@query("m01_match_onsets", "house:i device:s g_id:i p_id:i g_on:i p_on:i", rec(MATCH_SQL, "SELECT * FROM mt"), views="channels", ctes=TP_CTES)
def m01(t):
    return matched(t, band=False)[2]


@query("m01_match_rounds", "house:i device:s g_id:i p_id:i g_on:i p_on:i", rec(MATCH_SQL, "SELECT * FROM mt"), views="channels", ctes=TP_CTES)
def m01_rounds(t):
    """The same over chunks hardly wider than the tolerance, so that onsets wait across most edges."""
    g, p = truth_pred(t)
    return M.match_onsets(g, p, KEYS, TAU, chunk_us=1)


SCORE_TAIL = """
SELECT {by} AS device, n_gt, n_pred, coalesce(n_matched, 0) AS n_matched, coalesce(n_matched, 0) / n_pred AS precision, coalesce(n_matched, 0) / n_gt AS recall,
 2.0 * coalesce(n_matched, 0) / (n_pred + n_gt) AS f1 FROM (SELECT {by}, count(*) AS n_gt FROM ep GROUP BY ALL) a JOIN (SELECT {by}, count(*) AS n_pred FROM pr GROUP BY ALL) b USING ({by})
 LEFT JOIN (SELECT {by}, count(*) AS n_matched FROM mk GROUP BY ALL) c USING ({by})"""


@query("m04_device_scores", "device:s n_gt:i n_pred:i n_matched:i precision:d recall:d f1:d", rec(MATCH_SQL, SCORE_TAIL.format(by="device")), views="channels", ctes=TP_CTES)
def m04(t):
    g, p, m = matched(t)
    return M.score(g, p, m, ["device"])


@query("a39_pooled_prf", "n_gt:i n_pred:i n_matched:i precision:d recall:d f1:d r:d", rec(MATCH_SQL, """
SELECT n_gt, n_pred, n_matched, n_matched / n_pred AS precision, n_matched / n_gt AS recall, 2.0 * n_matched / (n_pred + n_gt) AS f1, r
FROM (SELECT count(*) AS n_gt FROM ep), (SELECT count(*) AS n_pred FROM pr), (SELECT count(*) AS n_matched, corr(p_on, g_on) AS r FROM mk)"""), views="channels", ctes=TP_CTES)
def a39(t):
    g, p, m = matched(t)
    one = lambda d, o: d.agg(F.count(F.lit(1)).alias(o))
    mm = m.agg(F.count(F.lit(1)).alias("n_matched"), F.corr(F.col("p_on").cast("double"), F.col("g_on").cast("double")).alias("r"))
    return one(g, "n_gt").crossJoin(one(p, "n_pred")).crossJoin(mm).select("*", *prf(F.col("n_matched"), F.col("n_pred"), F.col("n_gt")))  # one row each


@query("a40_span_stats", "device:s n_pairs:i onset_med_s:d onset_p90_abs_s:d offset_med_s:d offset_p90_abs_s:d dur_ratio_med:d iou_med:d", rec(MATCH_SQL, """
SELECT device, count(*) AS n_pairs, quantile_cont(onset_err_s, 0.5) AS onset_med_s, quantile_cont(abs(onset_err_s), 0.9) AS onset_p90_abs_s, quantile_cont(offset_err_s, 0.5) AS offset_med_s,
 quantile_cont(abs(offset_err_s), 0.9) AS offset_p90_abs_s, quantile_cont(dur_ratio, 0.5) AS dur_ratio_med, quantile_cont(iou, 0.5) AS iou_med FROM mk GROUP BY device"""), views="channels", ctes=TP_CTES)
def a40(t):
    return M.span_stats(matched(t)[2], ["device"])


@query("m05_strata_recall", "stratum:s n_gt:i n_matched:i recall:d", rec(MATCH_SQL, """
SELECT CASE WHEN co THEN 'co' ELSE 'solo' END AS stratum, count(*) AS n_gt, count(mk.g_on) AS n_matched, count(mk.g_on) / count(*) AS recall FROM (SELECT *, EXISTS (SELECT 1 FROM ep b WHERE b.house = ep.house AND b.device <> ep.device
 AND ep.t_on_us < b.t_off_us AND b.t_on_us < ep.t_off_us) AS co FROM ep) e LEFT JOIN mk ON mk.house = e.house AND mk.device = e.device AND mk.g_on = e.t_on_us GROUP BY 1"""), views="channels", ctes=TP_CTES)
def m05(t):
    """Recall of lone and co-occurring truth (precision per stratum is 1 by construction)."""
    g, _, m = matched(t)
    co = PR.tag_cooccurring(g, ["house"], bucket_us=4 * HB)
    j = co.join(m.select("house", "device", F.col("g_on").alias("t_on_us"), F.lit(1).alias("hit")), ["house", "device", "t_on_us"], "left")
    s = j.groupBy(F.when(F.col("co"), "co").otherwise("solo").alias("stratum")).agg(F.count(F.lit(1)).alias("n_gt"), F.count("hit").alias("n_matched"))
    return s.withColumn("recall", F.col("n_matched") / F.col("n_gt"))


# best-first greedy as a walk over the sorted candidates of a channel
GREEDY_SQL = """
srt AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS n FROM cand),
gw({k}, n, ug, ud, gi, di) AS (SELECT DISTINCT {k}, CAST(1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM srt
 UNION ALL SELECT {gk}, gw.n + 1,
  CASE WHEN list_contains(ug, c.g_id) OR list_contains(ud, c.d_id) THEN ug ELSE list_append(ug, c.g_id) END,
  CASE WHEN list_contains(ug, c.g_id) OR list_contains(ud, c.d_id) THEN ud ELSE list_append(ud, c.d_id) END,
  CASE WHEN list_contains(ug, c.g_id) OR list_contains(ud, c.d_id) THEN NULL ELSE c.g_id END,
  CASE WHEN list_contains(ug, c.g_id) OR list_contains(ud, c.d_id) THEN NULL ELSE c.d_id END
 FROM gw JOIN srt c ON {on} AND c.n = gw.n),
gm AS (SELECT {k}, gi AS g_id, di AS d_id FROM gw WHERE gi IS NOT NULL)"""


def greedy_sql(order, keys=("house", "device")):
    return GREEDY_SQL.format(order=order, k=", ".join(keys), gk=", ".join(f"gw.{k}" for k in keys), on=" AND ".join(f"c.{k} = gw.{k}" for k in keys))


CAND_SQL = f"""
gg AS (SELECT house, device, t_on_us AS s, (t_off_us - t_on_us) // 1000000 AS l, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS g_id FROM ep),
dd AS (SELECT house, device, t_on_us AS s, (t_off_us - t_on_us) // 1000000 AS l, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS d_id FROM pr),
cand AS (SELECT gg.house, gg.device, g_id, d_id, abs(gg.s - dd.s) AS ae, gg.s AS gs FROM gg JOIN dd ON gg.house = dd.house AND gg.device = dd.device AND abs(gg.s - dd.s) <= 86400000000 AND gg.l / greatest(dd.l, 1) BETWEEN 0.5 AND 2)"""


def as_units(df):
    e = M._events(df, KEYS, 0)
    return e.select(*KEYS, "id", F.col("t").alias("start"), bucket_of(F.col("off") - F.col("t"), 1_000_000).alias("length"))


@query("m02_match_best", "house:i device:s g_id:i d_id:i", rec(CAND_SQL + "," + greedy_sql("ae, gs, d_id, g_id"), "SELECT * FROM gm"), views="channels", ctes=TP_CTES)
def m02(t):
    g, p = truth_pred(t)
    return M.match_best(as_units(g), as_units(p), KEYS, tol=DAY_US)


OVC_SQL = """
gg AS (SELECT house, device, t_on_us AS a, t_off_us AS b, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS g_id FROM ep),
dd AS (SELECT house, device, t_on_us AS a, t_off_us AS b, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS d_id FROM pr),
cand AS (SELECT gg.house, gg.device, g_id, d_id, least(gg.b, dd.b) - greatest(gg.a, dd.a) AS ov FROM gg JOIN dd ON gg.house = dd.house AND gg.device = dd.device AND gg.a < dd.b AND dd.a < gg.b
 AND least(gg.b, dd.b) - greatest(gg.a, dd.a) >= least(60e6, 0.3 * (gg.b - gg.a)))"""


@query("m03_match_overlap", "house:i device:s g_id:i d_id:i", rec(OVC_SQL + "," + greedy_sql("-ov, -g_id, -d_id"), "SELECT * FROM gm"), views="channels", ctes=TP_CTES)
def m03(t):
    g, p = truth_pred(t)
    ids = lambda d: M._events(d, KEYS, 0).select(*KEYS, "id", F.col("t").alias("t0_us"), F.col("off").alias("t1_us"))
    return M.match_overlap(ids(g), ids(p), KEYS, bucket_us=4 * HB).withColumnRenamed("c_id", "d_id")


@query("m25_confusability", "device:s claimed_by:s n:i", views="channels", ctes=TP_CTES, sql="""
SELECT ep.device, p.device AS claimed_by, count(DISTINCT (ep.house, ep.t_on_us)) AS n FROM ep JOIN pr p ON ep.house = p.house AND ep.device <> p.device AND ep.t_on_us < p.t_off_us AND p.t_on_us < ep.t_off_us GROUP BY 1, 2""")
def m25(t):
    from ..operators.joins import overlap_join

    g, p = truth_pred(t)
    j = overlap_join(g, p, ["house"], left_span=("t_on_us", "t_off_us"), right_span=("t_on_us", "t_off_us"), bucket_us=4 * HB, extra=F.col("l.device") != F.col("r.device"))
    return (j.select("house", F.col("l.device").alias("device"), F.col("r.device").alias("claimed_by"), F.col("l.t_on_us").alias("t")).distinct()
            .groupBy("device", "claimed_by").agg(F.count(F.lit(1)).alias("n")))


@query("m25_negative_control", "device:s total:i fp:i fp_rate_pct:d", views="channels", ctes=TP_CTES, sql="""
SELECT pr.device, count(*) AS total, count(*) FILTER (NOT hit) AS fp, 100.0 * count(*) FILTER (NOT hit) / count(*) AS fp_rate_pct
FROM (SELECT *, EXISTS (SELECT 1 FROM ep WHERE ep.house = pr.house AND ep.device <> pr.device AND ep.t_on_us < pr.t_off_us AND pr.t_on_us < ep.t_off_us) AS hit FROM pr) pr GROUP BY 1""")
def m25_neg(t):
    """Detections that overlap no episode of the other devices of the house."""
    g, p = truth_pred(t)
    f = overlap_flag(p, g, ["house"], left_span=("t_on_us", "t_off_us"), right_span=("t_on_us", "t_off_us"), out="hit", left_id=["device", "t_on_us"], bucket_us=4 * HB,
                     extra=F.col("l.device") != F.col("r.device"))
    a = f.groupBy("device").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("hit")).alias("fp"))
    return a.withColumn("fp_rate_pct", 100 * F.col("fp") / F.col("total"))


@query("m26_residual_coverage", "house:i above_wh:d covered_pct:d residual_wh:d", views="channels mains", ctes=TP_CTES, sql="""
WITH fl AS (SELECT house, quantile_cont(p10, 0.5) AS f FROM (SELECT house, ts_us // 86400000000 AS d, quantile_cont(w, 0.1) AS p10 FROM mains GROUP BY 1, 2) GROUP BY house),
a AS (SELECT m.house, greatest(w - f, 0) AS x, EXISTS (SELECT 1 FROM pr WHERE pr.house = m.house AND m.ts_us BETWEEN pr.t_on_us AND pr.t_off_us) AS cov FROM mains m JOIN fl ON m.house = fl.house)
SELECT house, sum(x) AS above_wh, 100.0 * sum(CASE WHEN cov THEN x ELSE 0 END) / sum(x) AS covered_pct, sum(CASE WHEN cov THEN 0 ELSE x END) AS residual_wh FROM a GROUP BY house""")
def m26(t):
    from ..operators.stats import always_on_floor

    _, p = truth_pred(t)
    d = join_dim(t.mains, always_on_floor(t.mains, ["house"]), ["house"]).withColumn("x", F.greatest(F.col("w") - F.col("always_on_w"), F.lit(0.0)))
    tot = d.groupBy("house").agg(F.sum("x").alias("above_wh"))
    cov = points_in(d, p, ["house"], start="t_on_us", end="t_off_us", bucket_us=4 * HB, how="left_semi").groupBy("house").agg(F.sum("x").alias("c"))
    j = tot.join(cov, "house", "left").fillna(0.0, ["c"])
    return j.select("house", "above_wh", (100 * F.col("c") / F.col("above_wh")).alias("covered_pct"), (F.col("above_wh") - F.col("c")).alias("residual_wh"))


@query("g12_attribution_error", "device:s n:i signed_p50:d abs_p50:d", rec(MATCH_SQL, """, e AS (SELECT house, ts_us, w FROM mains), fl AS (SELECT house, quantile_cont(w, 0.1) AS f FROM mains GROUP BY house),
a AS (SELECT mk.house, mk.device, mk.g_on, sum(e.w - f) AS est FROM mk JOIN e ON e.house = mk.house AND e.ts_us BETWEEN mk.p_on AND mk.p_off JOIN fl ON fl.house = mk.house GROUP BY 1, 2, 3),
c AS (SELECT mk.house, mk.device, mk.g_on, sum(c.w) AS tru FROM mk JOIN channels c ON c.house = mk.house AND c.device = mk.device AND c.ts_us BETWEEN mk.g_on AND mk.g_off GROUP BY 1, 2, 3)
SELECT a.device, count(*) AS n, quantile_cont((est - tru) / tru, 0.5) AS signed_p50, quantile_cont(abs((est - tru) / tru), 0.5) AS abs_p50 FROM a JOIN c ON a.house = c.house AND a.device = c.device AND a.g_on = c.g_on GROUP BY a.device"""),
       views="channels mains", ctes=TP_CTES)
def g12(t):
    """Floor-corrected mains inside the predicted span against the channel inside the true one."""
    m = matched(t)[2]
    fl = exact_quantiles(t.mains, ["house"], {"f": ("w", 0.1)})
    d = join_dim(t.mains.select("house", "ts_us", "w"), fl, ["house"]).withColumn("x", F.col("w") - F.col("f"))
    est = points_in(d, m.select("house", "device", "g_on", "p_on", "p_off"), ["house"], start="p_on", end="p_off", bucket_us=4 * HB).groupBy("house", "device", "g_on").agg(F.sum("x").alias("est"))
    tru = points_in(t.channels.select("house", "device", "ts_us", "w"), m.select("house", "device", "g_on", "g_off").withColumn("g0", F.col("g_on")), ["house", "device"], start="g0", end="g_off",
                    bucket_us=4 * HB).groupBy("house", "device", "g_on").agg(F.sum("w").alias("tru"))
    j = est.join(tru, ["house", "device", "g_on"]).withColumn("rel", (F.col("est") - F.col("tru")) / F.col("tru")).withColumn("abs_rel", F.abs("rel"))
    return exact_quantiles(j, ["device"], {"signed_p50": ("rel", 0.5), "abs_p50": ("abs_rel", 0.5)}, {"n": "rel"})


@query("m06_nmae", "house:i device:s n_common:i mae_w:d den_w:d nmae:d", views="channels mains", ctes=TP_CTES, sql="""
WITH dn AS (SELECT house, avg(w) AS den FROM mains GROUP BY house),
x AS (SELECT c.house, c.device, c.w, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.house = c.house AND pr.device = c.device AND c.ts_us BETWEEN pr.t_on_us AND pr.t_off_us) THEN 60.0 ELSE 0.0 END AS p FROM channels c)
SELECT x.house, x.device, count(*) AS n_common, avg(abs(p - w)) AS mae_w, any_value(den) AS den_w, avg(abs(p - w)) / any_value(den) AS nmae FROM x JOIN dn ON x.house = dn.house GROUP BY 1, 2""")
def m06(t):
    """A 60 W claim inside predicted spans against the channel on its own stamps."""
    _, p = truth_pred(t)
    c = t.channels.select("house", "device", "ts_us", "w")
    on = points_in(c, p, KEYS, start="t_on_us", end="t_off_us", bucket_us=4 * HB, how="left_semi").select(*KEYS, "ts_us").distinct().withColumn("p", F.lit(60.0))
    x = c.join(on, [*KEYS, "ts_us"], "left").fillna(0.0, ["p"])
    den = t.mains.groupBy("house").agg(F.avg("w").alias("den_w"))
    e = x.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_common"), F.avg(F.abs(F.col("p") - F.col("w"))).alias("mae_w")).join(den, "house")
    return e.withColumn("nmae", F.col("mae_w") / F.col("den_w"))


@query("m06_mse", "house:i device:s n_common:i mae_w:d mse_w2:d rmse_w:d", views="channels mains", ctes=TP_CTES, sql="""
WITH x AS (SELECT c.house, c.device, c.w, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.house = c.house AND pr.device = c.device AND c.ts_us BETWEEN pr.t_on_us AND pr.t_off_us) THEN 60.0 ELSE 0.0 END AS p FROM channels c)
SELECT house, device, count(*) AS n_common, avg(abs(p - w)) AS mae_w, avg((p - w) * (p - w)) AS mse_w2, sqrt(avg((p - w) * (p - w))) AS rmse_w FROM x GROUP BY 1, 2""")
def m06_mse(t):
    """Squared error beside the absolute one, for the same 60 W claim."""
    _, p = truth_pred(t)
    c = t.channels.select("house", "device", "ts_us", "w")
    on = points_in(c, p, KEYS, start="t_on_us", end="t_off_us", bucket_us=4 * HB, how="left_semi").select(*KEYS, "ts_us").distinct().withColumn("p", F.lit(60.0))
    d = F.coalesce("p", F.lit(0.0)) - F.col("w")
    e = c.join(on, [*KEYS, "ts_us"], "left").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_common"), F.avg(F.abs(d)).alias("mae_w"), F.avg(d * d).alias("mse_w2"))
    return e.withColumn("rmse_w", F.sqrt("mse_w2"))


FIRST_SQL = f"""
ga AS (SELECT house, device, list(t_on_us ORDER BY t_on_us, t_off_us) AS gs FROM ep GROUP BY 1, 2),
pj AS (SELECT house, device, t_on_us, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us, t_off_us) AS j FROM pr),
walk AS (SELECT house, device, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used FROM ga
 UNION ALL
 SELECT w.house, w.device, p.j, list_append(w.used, list_filter(range(1, len(gs) + 1), lambda k: abs(gs[k] - p.t_on_us) <= {TAU} AND NOT list_contains(w.used, k))[1])
 FROM walk w JOIN pj p ON p.house = w.house AND p.device = w.device AND p.j = w.j + 1 JOIN ga ON ga.house = w.house AND ga.device = w.device),
mt AS (SELECT house, device, len(list_filter(arg_max(used, j), lambda k: k IS NOT NULL)) AS n FROM walk GROUP BY 1, 2)"""


@query("m41_first_fit", "device:s tp:i f1:d", rec(FIRST_SQL, """
SELECT device, n AS tp, 2.0 * n / (a + b) AS f1 FROM (SELECT device, sum(n) AS n FROM mt GROUP BY device) JOIN (SELECT device, count(*) AS a FROM ep GROUP BY device) USING (device) JOIN (SELECT device, count(*) AS b FROM pr GROUP BY device) USING (device)"""),
       views="channels", ctes=TP_CTES)
def m41(t):
    """Each prediction takes the first unused truth; the SQL keeps the list of those used."""
    g, p = truth_pred(t)
    s = M.score(g, p, M.match_first_fit(g, p, KEYS, TAU, chunk_us=CH), ["device"])
    return s.select("device", F.col("n_matched").alias("tp"), "f1")
