"""Queries on projections, labels, sampling, set operations, functions and waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels as L
from ..functions import scalars as SC
from ..operators import episodes as X
from ..operators import resample as RS
from ..operators import sampling as SA
from ..operators import stats as ST
from ..operators import waveform as V
from ..operators.ordered import DAY_US, bucket_of, islands, join_dim, ordered_scan
from ..session import cut_lineage
from ..operators.quantiles import exact_quantiles
from ..sources.readings import common_span, drop_null_ts, normalise_watts, unpivot_channels
from .catalog import query
from .series_plans import CH, CHANNEL_EP, H, THR, channel_episodes, episodes_sql, spans


@query("flagship_channel_report", "house:i device:s thr_on_w:d n_ep:i dur_p50:d energy_wh:d", views="channels", ctes="""
thr AS (SELECT house, device, round_even(greatest(5, 0.5 * quantile_cont(CASE WHEN w > 5 THEN w END, 0.5)), 1) AS thr FROM channels GROUP BY 1, 2), ct AS (SELECT c.*, thr FROM channels c JOIN thr ON c.house = thr.house AND c.device = thr.device),
""" + episodes_sql("ct", "house, device", "w > thr"), sql="""
SELECT t.house, t.device, thr AS thr_on_w, e.n AS n_ep, e.p AS dur_p50, e.s AS energy_wh FROM thr t JOIN (SELECT house, device, count(*) AS n, quantile_cont(dur_s, 0.5) AS p, sum(energy_wh) AS s FROM ep GROUP BY 1, 2) e ON t.house = e.house AND t.device = e.device""")
def flagship(t):
    """Half-median threshold, episodes above it and their energy, per channel."""
    k = ["house", "device"]
    q = exact_quantiles(t.channels.where("w > 5"), k, {"p50": ("w", 0.5)})
    thr = q.select(*k, ST.round_even(F.greatest(F.lit(5.0), 0.5 * F.col("p50")), 1).alias("thr_on_w"))
    d = join_dim(t.channels, thr, k)
    runs = X.state_runs(d, k, X.on_mark(F.col("w") > F.col("thr_on_w")), hold_s=7200, chunk_us=CH, aggs={"thr_on_w": ("max", F.col("thr_on_w"))}).where("state = 1")
    m = X.merge_intervals(runs, k, "t_on_us", "t_off_us", X.us(21600), chunk_us=8 * CH, aggs={"energy_wh": ("sum", F.col("energy_wh")), "thr_on_w": ("max", F.col("thr_on_w"))})
    ep = cut_lineage(m.withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6).where("dur_s >= 3600"))  # episodes only, read twice
    e = ep.groupBy(*k).agg(F.sum("energy_wh").alias("energy_wh"), F.max("thr_on_w").alias("thr_on_w"))
    return exact_quantiles(ep, k, {"dur_p50": ("dur_s", 0.5)}, {"n_ep": "dur_s"}).join(e, k)


# ---------------------------------------------------------------- projections and predicates

@query("p01_drop_null_stamps", "house:i n:i dropped:i mean_w:d", sql="""
SELECT user_id % 5 AS house, count(*) FILTER (event_id % 10 <> 3) AS n, count(*) FILTER (event_id % 10 = 3) AS dropped, avg(CASE WHEN event_id % 10 <> 3 THEN value END) AS mean_w FROM events GROUP BY 1""")
def p01(t):
    d = t.mains.withColumn("ts_us", F.when(F.col("seq") % 10 != 3, F.col("ts_us")))
    k = drop_null_ts(d).groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))
    return k.join(d.groupBy("house").agg(F.count_if(F.col("ts_us").isNull()).alias("dropped")), "house")


@query("p02_mains_projection", "ds:s n:i w:d", sql="""
SELECT CASE o_orderstatus WHEN 'O' THEN 'price' WHEN 'F' THEN 'key' ELSE 'cust' END AS ds, count(*) AS n, sum(CASE o_orderstatus WHEN 'O' THEN o_totalprice / 1000 WHEN 'F' THEN o_orderkey ELSE o_custkey END) AS w FROM orders GROUP BY 1""")
def p02(t):
    """Each source names its own mains column."""
    st = F.col("o_orderstatus")
    w = F.when(st == "O", F.col("o_totalprice") / 1000).when(st == "F", F.col("o_orderkey")).otherwise(F.col("o_custkey"))
    return t.orders.groupBy(F.when(st == "O", "price").when(st == "F", "key").otherwise("cust").alias("ds")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))


@query("p03_unpivot_channels", "channel:s k:i n:i mean_w:d", sql="""
WITH u AS (SELECT 'l_quantity' AS channel, 1 AS k, l_quantity AS w FROM lineitem UNION ALL SELECT 'l_discount', 2, l_discount FROM lineitem UNION ALL SELECT 'l_tax', 3, l_tax FROM lineitem) SELECT channel, k, count(*) AS n, avg(w) AS mean_w FROM u GROUP BY 1, 2""")
def p03(t):
    u = unpivot_channels(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"])
    return u.groupBy("channel", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))


@query("p04_local_clock", "hr:i n:i max_off_h:d", sql="""
SELECT hour(l) AS hr, count(*) AS n, max(abs(epoch_us(l) - epoch_us(ts)) / 3.6e9) AS max_off_h FROM (SELECT o_orderdate + to_hours(o_orderkey % 24) AS ts, o_orderdate + to_hours(o_orderkey % 24)
 + CASE WHEN o_orderdate + to_hours(o_orderkey % 24) >= s AND o_orderdate + to_hours(o_orderkey % 24) < e THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS l
 FROM orders JOIN (SELECT y, CAST(make_date(y, 3, 31) - CAST(dayofweek(make_date(y, 3, 31)) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AS s, CAST(CASE WHEN y = 1995 THEN make_date(1995, 10, 22) ELSE make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) END AS TIMESTAMP) + INTERVAL 1 HOUR AS e FROM range(1990, 2010) r(y)) z ON z.y = year(o_orderdate)) GROUP BY 1""")
def p04(t):
    """UTC to a named zone with summer time; the offset never exceeds an hour."""
    ts = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * H
    d = t.orders.select(ts.alias("ts_us")).withColumn("l", SC.local_us("ts_us", "Europe/London"))
    return d.groupBy(SC.hour_of("l").alias("hr")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("l") - F.col("ts_us")) / 3.6e9).alias("max_off_h"))


@query("p05_hour_weekday", "hr:i wd:i n:i", sql="SELECT (epoch_us(ts) // 3600000000 + 1) % 24 AS hr, (isodow(ts) - 1) AS wd, count(*) AS n FROM events GROUP BY 1, 2")
def p05(t):
    return t.mains.groupBy(SC.hour_of("ts_us", 1).alias("hr"), SC.weekday_of("ts_us").alias("wd")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_month_key", "ym:i n:i", sql="SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, count(*) AS n FROM orders GROUP BY 1")
def p06(t):
    return t.orders.select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us")).groupBy(SC.month_key("ts_us").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_sentinels", "house:i n:i n_valid:i mean_w:d", sql="""
SELECT user_id % 5 AS house, count(*) AS n, count(*) FILTER (event_id % 9 <> 0 AND event_id % 11 <> 0) AS n_valid, avg(CASE WHEN event_id % 9 <> 0 AND event_id % 11 <> 0 THEN value END) AS mean_w FROM events GROUP BY 1""")
def p07(t):
    raw = F.when(F.col("seq") % 9 == 0, -1.0).when(F.col("seq") % 11 == 0, float("nan")).otherwise(F.col("w"))
    d = t.mains.withColumn("w", normalise_watts(raw, (-1.0,)))
    return d.groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("n_valid"), F.avg("w").alias("mean_w"))


@query("p08_time_window", "device:s n:i sum_w:d", sql="SELECT event_type AS device, count(*) AS n, sum(value) AS sum_w FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def p08(t):
    """Half-open window on the stored column, so it reaches the scan."""
    d = t.events.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return d.groupBy(F.col("event_type").alias("device")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_w"))


@query("p09_bad_clock_runs", "n_rows:i first_key:i last_key:i", sql="""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS bad FROM orders), b AS (SELECT *, CASE WHEN bad = lag(bad) OVER (ORDER BY o_orderkey) THEN 0 ELSE 1 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (ORDER BY o_orderkey) AS rid FROM b) SELECT count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM c WHERE bad = 1 GROUP BY rid HAVING count(*) >= 4""")
def p09(t):
    d = t.orders.select(F.lit(0).alias("k"), "o_orderkey", (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("bad"))
    r = islands(d, ["k"], ["o_orderkey"], bucket_of("o_orderkey", 4096), row={"i": "o_orderkey", "bad": "bad"}, breaks=lambda p, c: p["bad"] != c["bad"])
    return r.where(F.col("first.bad") & (F.col("n_rows") >= 4)).select("n_rows", F.col("first.i").alias("first_key"), F.col("last.i").alias("last_key"))


@query("p10_plausibility_gates", "meter:i n_over:i share_over:d p50:d spurious:b", views="readings", sql="""
SELECT meter, count(*) FILTER (w > 150) AS n_over, avg(CASE WHEN w > 150 THEN 1.0 ELSE 0.0 END) AS share_over, quantile_cont(w, 0.5) AS p50, max(w) > 200 AND quantile_cont(w, 0.5) < 40 AND avg(CASE WHEN w > 200 THEN 1.0 ELSE 0.0 END) < 0.02 AS spurious FROM readings GROUP BY meter""")
def p10(t):
    g = t.readings.groupBy("meter").agg(F.count_if(F.col("w") > 150).alias("n_over"), F.avg((F.col("w") > 150).cast("int")).alias("share_over"), F.max("w").alias("mx"), F.avg((F.col("w") > 200).cast("int")).alias("sp"))
    g = g.join(exact_quantiles(t.readings, ["meter"], {"p50": ("w", 0.5)}), "meter")
    return g.withColumn("spurious", (F.col("mx") > 200) & (F.col("p50") < 40) & (F.col("sp") < 0.02))


@query("p11_zero_scars", "house:i ts_us:i", views="mains", sql="""
SELECT house, ts_us FROM (SELECT *, lag(w) OVER o AS a, lead(w) OVER o AS b FROM mains WINDOW o AS (PARTITION BY house ORDER BY ts_us, seq)) WHERE w < 5 AND a > 60 AND b > 60""")
def p11(t):
    d = ordered_scan(t.mains, ["house"], ["ts_us", "seq"], bucket_of("ts_us", DAY_US), lag={"a": "w"}, lead={"b": "w"})
    return d.where("w < 5 and a > 60 and b > 60")


@query("p12_staircase", "house:i n_violations:i first_us:i", sql="""
SELECT user_id % 5 AS house, count(*) AS n_violations, min(epoch_us(ts)) AS first_us FROM events WHERE CASE WHEN epoch_us(ts) < 1705363200000000 THEN round(value / 10) * 10 ELSE value END <> round(CASE WHEN epoch_us(ts) < 1705363200000000 THEN round(value / 10) * 10 ELSE value END / 10) * 10 GROUP BY 1""")
def p12(t):
    """The first reading off the 10 W staircase marks a change of meter."""
    w = F.when(F.col("ts_us") < 1705363200000000, F.round(F.col("w") / 10) * 10).otherwise(F.col("w"))
    return t.mains.withColumn("w", w).where(~SC.on_step_of(F.col("w"))).groupBy("house").agg(F.count(F.lit(1)).alias("n_violations"), F.min("ts_us").alias("first_us"))


@query("p13_floor_transform", "device:s n_zero:i mean_w:d", sql="SELECT event_type AS device, count(*) FILTER (value < 30) AS n_zero, avg(CASE WHEN value < 30 THEN 0 ELSE value END) AS mean_w FROM events GROUP BY 1")
def p13(t):
    from ..operators.sweeps import floor_variant

    d = t.devices.withColumn("v", floor_variant(F.col("w"), 30.0))
    return d.groupBy("device").agg(F.count_if(F.col("v") == 0).alias("n_zero"), F.avg("v").alias("mean_w"))


# ---------------------------------------------------------------- labels

# labels that stand on the parts, by key
LABEL_LIST = ("Washing_Machine", "washer  dryer", "Fridge-Freezer", "kettle_radio", "Dish Washer", "TV", "Coffee machine!", "", "microwave")
LABEL_OF_SQL = "[" + ", ".join(f"'{x}'" for x in LABEL_LIST) + "][p_partkey % 9 + 1]"
CANON_SQL = """CASE WHEN regexp_matches(n, 'kettle') THEN 'kettle' WHEN regexp_matches(n, 'microwave') THEN 'microwave' WHEN regexp_matches(n, 'fridge|freezer') THEN 'fridge'
 WHEN regexp_matches(n, 'washing machine|washer dryer|clothes washer') THEN 'washing_machine' WHEN regexp_matches(n, 'dish ?washer') THEN 'dishwasher' END"""
LAB_SQL = f"""
lab0 AS (SELECT p_partkey AS meter, p_partkey // 40 AS building, {LABEL_OF_SQL} AS label FROM part),
lab1 AS (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g') AS n, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unlabeled') AS slug FROM lab0),
lab AS (SELECT *, {CANON_SQL} AS canonical FROM lab1)"""


def part_labels(t):
    lab = F.element_at(F.array(*map(F.lit, LABEL_LIST)), (F.col("p_partkey") % 9 + 1).cast("int"))
    d = t.part.select(F.col("p_partkey").alias("meter"), bucket_of("p_partkey", 40).alias("building"), lab.alias("label"))
    return d.withColumn("canonical", L.canonical_label(F.col("label")))


@query("l01_canonical_labels", "meter:i label:s canonical:s", ctes=LAB_SQL, sql="SELECT * FROM lab")
def l01(t):
    return part_labels(t)


@query("l02_slugs", "label:s slug:s n:i", ctes=LAB_SQL, sql="SELECT label, slug, count(*) AS n FROM lab GROUP BY 1, 2")
def l02(t):
    return part_labels(t).groupBy("label", L.slug(F.col("label")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("l03_building_names", "building:i meter:i name:s", ctes=LAB_SQL, sql="""
WITH f AS (SELECT building, canonical, min(meter) AS m FROM lab WHERE canonical IS NOT NULL GROUP BY 1, 2),
e AS (SELECT lab.*, f.m IS NOT NULL AND f.m = meter AS own, CASE WHEN lab.canonical IS NOT NULL THEN lab.canonical ELSE slug END AS base FROM lab LEFT JOIN f ON lab.building = f.building AND lab.canonical = f.canonical),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.building, base ORDER BY meter) + CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.building = e.building AND f.canonical = e.base) THEN 1 ELSE 0 END AS k FROM e WHERE NOT own)
SELECT building, meter, canonical AS name FROM e WHERE own UNION ALL SELECT building, meter, CASE WHEN k = 1 THEN base ELSE base || '_' || k END FROM r""")
def l03(t):
    return L.building_names(part_labels(t), ["building"], "meter")


@query("l04_parse_labels", "meter:i label:s n:i", sql="SELECT p_partkey % 50 AS meter, p_name AS label, count(*) AS n FROM part GROUP BY 1, 2")
def l04(t):
    """`<meter> <label>` lines back to records with a multiplicity count."""
    lines = t.part.select(F.concat_ws("  ", (F.col("p_partkey") % 50).cast("string"), "p_name").alias("value"))
    return L.parse_label_lines(lines).groupBy("meter", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l04_plug_table", "page:i meter:i label:s", sql="SELECT p_partkey // 20 AS page, p_partkey AS meter, p_name AS label FROM part")
def l04_plugs(t):
    item = F.concat(F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name"), F.lit(" (30 days)"))
    text = t.part.groupBy(bucket_of("p_partkey", 20).alias("page")).agg(F.array_join(F.collect_list(item), "\n").alias("value"))  # 20 plugs a page
    return L.parse_plug_table(text)


@query("l05_merge_label_maps", "source:s n:i n_canonical:i", ctes=LAB_SQL, sql="""
SELECT CASE WHEN meter % 3 = 0 THEN 'a' WHEN meter % 3 = 1 THEN 'b' ELSE 'c' END AS source, count(*) AS n, count(canonical) AS n_canonical FROM lab GROUP BY 1""")
def l05(t):
    d = part_labels(t)
    parts = [d.where(F.col("meter") % 3 == i).withColumn("source", F.lit(s)) for i, s in enumerate("abc")]
    parts[2] = parts[2].withColumn("room", F.lit("kitchen"))
    m = L.merge_label_maps(*parts)
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("canonical").alias("n_canonical"))


@query("l06_anchor_check", "building:i n_declared:i n_found:i matches:b", ctes=LAB_SQL, sql="""
WITH d AS (SELECT building, meter FROM lab WHERE meter % 9 = 7 AND meter % 4 <> 0), f AS (SELECT building, meter FROM lab WHERE label = '')
SELECT coalesce(d.building, f.building) AS building, count(d.meter) AS n_declared, count(f.meter) AS n_found, count(*) = count(d.meter) AND count(*) = count(f.meter) AS matches FROM d FULL OUTER JOIN f ON d.building = f.building AND d.meter = f.meter GROUP BY 1""")
def l06(t):
    """Unlabelled meters of a building against its declared site meters."""
    p = part_labels(t)
    d = p.where((F.col("meter") % 9 == 7) & (F.col("meter") % 4 != 0)).select("building", "meter", F.lit(1).alias("d"))
    f = p.where("label = ''").select("building", "meter", F.lit(1).alias("f"))
    g = d.join(f, ["building", "meter"], "full_outer").groupBy("building").agg(F.count("d").alias("n_declared"), F.count("f").alias("n_found"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("matches", (F.col("n") == F.col("n_declared")) & (F.col("n") == F.col("n_found")))


@query("l07_class_prior", "class:s n:i", ctes=LAB_SQL, sql="""
SELECT CASE WHEN s IN ('washing_machine', 'dishwasher', 'coffee_machine') THEN 'program' WHEN s IN ('kettle', 'microwave') THEN 'burst' WHEN s = 'fridge' THEN 'duty' WHEN s = 'tv' THEN 'electronics' ELSE 'misc' END AS class, count(*) AS n
FROM (SELECT coalesce(canonical, slug) AS s FROM lab) GROUP BY 1""")
def l07(t):
    d = part_labels(t).withColumn("dev", F.coalesce("canonical", L.slug(F.col("label"))))
    return d.groupBy(L.class_prior(F.col("dev")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sort, top-k, sampling, sets

@query("o01_sorted_series", "house:i n:i sorted:b", sql="SELECT user_id % 5 AS house, count(*) AS n, true AS sorted FROM events GROUP BY 1")
def o01(t):
    """Rows written in (house, ts) order: a range-partitioned sort, checked by lag."""
    d = t.mains.repartitionByRange("house", "ts_us").sortWithinPartitions("house", "ts_us", "seq")
    p = X.with_previous(d, ["house"], [])
    return p.groupBy("house").agg(F.count(F.lit(1)).alias("n"), (F.min(F.coalesce("dt_s", F.lit(0.0))) >= 0).alias("sorted"))


@query("o02_top_episodes", "device:s rank:i t_on_us:i energy_wh:d", views="channels", ctes=CHANNEL_EP, sql="""
SELECT device, rank, t_on_us, energy_wh FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY round(energy_wh, 6) DESC, t_on_us, house) AS rank FROM ep) WHERE rank <= 5""")
def o02(t):
    return SA.top_n(channel_episodes(t), ["device"], 5, F.round("energy_wh", 6).desc(), F.col("t_on_us"), F.col("house"))


@query("o03_first_episodes", "house:i device:s rank:i t_on_us:i", views="channels", ctes=CHANNEL_EP, sql="SELECT * FROM (SELECT house, device, row_number() OVER (PARTITION BY house, device ORDER BY t_on_us) AS rank, t_on_us FROM ep) WHERE rank <= 3")
def o03(t):
    return SA.first_n(channel_episodes(t), ["house", "device"], "t_on_us", 3)


@query("o04_stride_thinning", "house:i ts_us:i w:d", views="mains", sql="SELECT house, ts_us, w FROM (SELECT *, row_number() OVER (PARTITION BY house ORDER BY ts_us, seq) - 1 AS i FROM mains) WHERE i % 5 = 0")
def o04(t):
    """The stride is the operator."""
    return X.numbered(t.mains, ["house"]).where("i % 5 = 0")


@query("o05_bootstrap_bands", "device:s n:i dur_s_p5:d dur_s_p50:d dur_s_p95:d energy_wh_p50:d", views="channels", ctes=CHANNEL_EP, sql="""
WITH d AS (SELECT device, dur_s, energy_wh, row_number() OVER (PARTITION BY device ORDER BY t_on_us) AS i, count(*) OVER (PARTITION BY device) AS size FROM ep),
b AS (SELECT DISTINCT device, size FROM d), n AS (SELECT unnest([2, 5, 10, 20]) AS n), r AS (SELECT unnest(range(100)) AS draw),
s AS (SELECT device, size, n, draw, unnest(range(n)) AS slot FROM b, n, r),
m AS (SELECT s.device, n, draw, dur_s, energy_wh FROM s JOIN d ON d.device = s.device AND d.i = ('0x' || left(md5('42:' || n || ':' || draw || ':' || slot || ':' || s.device), 12))::BIGINT % s.size + 1),
q AS (SELECT device, n, draw, quantile_cont(dur_s, 0.5) AS a, quantile_cont(energy_wh, 0.5) AS e FROM m GROUP BY 1, 2, 3)
SELECT device, n, quantile_cont(a, 0.05) AS dur_s_p5, quantile_cont(a, 0.5) AS dur_s_p50, quantile_cont(a, 0.95) AS dur_s_p95, quantile_cont(e, 0.5) AS energy_wh_p50 FROM q GROUP BY 1, 2""")
def o05(t):
    ep = channel_episodes(t)
    return SA.bootstrap_medians(ep, ["device"], "t_on_us", ["dur_s", "energy_wh"], (2, 5, 10, 20), 100, 42)


@query("o07_label_subsample", "label:i n:i sum_id:i", sql="""
SELECT label, count(*) AS n, sum(vec_id) AS sum_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 20 GROUP BY label""")
def o07(t):
    return SA.subsample(t.embeddings.select("label", "vec_id"), "label", "vec_id", 20, 7).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("sum_id"))


@query("o08_splits", "house:i split_us:i n_cal:i n_test:i", views="mains", sql="""
WITH s AS (SELECT house, CASE WHEN house = 1 THEN 1705363200000000 ELSE (min(ts_us) + CAST(floor(0.7 * (max(ts_us) - min(ts_us))) AS BIGINT)) // 86400000000 * 86400000000 END AS split_us FROM mains GROUP BY house)
SELECT s.house, any_value(split_us) AS split_us, count(*) FILTER (ts_us < split_us) AS n_cal, count(*) FILTER (ts_us >= split_us) AS n_test FROM mains m JOIN s ON m.house = s.house GROUP BY s.house""")
def o08(t):
    from ..operators.ordered import join_dim

    s = SA.split_at(t.mains, ["house"], 0.7, fixed={1: 1705363200000000})
    d = join_dim(t.mains, s, ["house"])
    return d.groupBy("house").agg(F.max("split_us").alias("split_us"), F.count_if(F.col("ts_us") < F.col("split_us")).alias("n_cal"), F.count_if(F.col("ts_us") >= F.col("split_us")).alias("n_test"))


@query("u01_union_marks", "provenance:s n:i dur_s:d", views="channels", ctes=CHANNEL_EP, sql="SELECT CASE WHEN house < 2 THEN 'manual' ELSE 'rule' END AS provenance, count(*) AS n, sum(dur_s) AS dur_s FROM ep GROUP BY 1")
def u01(t):
    ep = channel_episodes(t)
    u = ep.where("house < 2").withColumn("provenance", F.lit("manual")).unionByName(ep.where("house >= 2").withColumn("provenance", F.lit("rule")))
    return u.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.sum("dur_s").alias("dur_s"))


@query("u02_label_sets", "kind:s n:i", sql="""
WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 3), b AS (SELECT DISTINCT p_name FROM part WHERE p_size >= 48)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u02(t):
    a, b = t.part.where("p_size <= 3").select("p_name"), t.part.where("p_size >= 48").select("p_name")
    n = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "a only")).unionByName(n(b.subtract(a), "b only"))


@query("u03_distinct_pairs", "house:i n_values:i n_pairs:i", sql="SELECT user_id % 5 AS house, count(DISTINCT value) AS n_values, count(DISTINCT (event_type, value)) AS n_pairs FROM events GROUP BY 1")
def u03(t):
    p = t.channels.select("house", "device", "w").dropDuplicates()
    v = p.select("house", "w").distinct().groupBy("house").agg(F.count(F.lit(1)).alias("n_values"))
    return p.groupBy("house").agg(F.count(F.lit(1)).alias("n_pairs")).join(v, "house")


# ---------------------------------------------------------------- functions

@query("f01_math", "seq:i clipped:d l2:d root:d cosd:d half_even:d sgn:d runmax:d", views="mains", sql="""
SELECT seq, least(greatest(w, 5), 100) AS clipped, log2(w + 1) AS l2, sqrt(w) AS root, cos(radians(w)) AS cosd, round_even(w, 0) AS half_even, sign(w - 50) AS sgn, max(w) OVER (PARTITION BY house ORDER BY ts_us, seq) AS runmax FROM mains""")
def f01(t):
    w = F.col("w")
    d = ordered_scan(t.mains, ["house"], ["ts_us", "seq"], bucket_of("ts_us", DAY_US), running_max={"runmax": "w"})
    return d.select("seq", SC.clip(w, 5.0, 100.0).alias("clipped"), F.log2(w + 1).alias("l2"), F.sqrt(w).alias("root"), F.cos(F.radians(w)).alias("cosd"), F.bround(w, 0).alias("half_even"), F.signum(w - 50).alias("sgn"), "runmax")


@query("f02_dates", "ym:i days_in_month:i n:i n_parsed:i", sql="""
SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, day(last_day(o_orderdate)) AS days_in_month, count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS n_parsed FROM orders GROUP BY 1, 2""")
def f02(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    d = t.orders.select("o_orderdate", F.try_to_timestamp(text).alias("p"))
    return d.groupBy(F.date_format("o_orderdate", "yyyyMM").cast("bigint").alias("ym"), F.dayofmonth(F.last_day("o_orderdate")).alias("days_in_month")).agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_parsed"))


@query("f03_strings", "brand:i word:s n:i", sql="SELECT CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS brand, upper(trim(string_split(p_name, ' ')[1])) AS word, count(*) AS n FROM part WHERE regexp_matches(p_name, 'ring|widget') GROUP BY 1, 2")
def f03(t):
    d = t.part.where(F.col("p_name").rlike("ring|widget"))
    return d.groupBy(F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("bigint").alias("brand"), F.upper(F.trim(F.split("p_name", " ")[0])).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_arrays", "house:i argmax_hour:i n_bins:i d0:i d1:i", sql="""
WITH h AS (SELECT user_id % 5 AS house, epoch_us(ts) // 3600000000 % 24 AS hr, sum(value) AS s FROM events GROUP BY 1, 2), b AS (SELECT user_id % 5 AS house, count(DISTINCT floor(value / 5)) AS n FROM events GROUP BY 1)
SELECT h.house, max_by(hr, s) AS argmax_hour, any_value(n) AS n_bins, h.house & 1 AS d0, (h.house >> 1) & 1 AS d1 FROM h JOIN b ON h.house = b.house GROUP BY h.house""")
def f04(t):
    m = t.mains.withColumn("hr", SC.hour_of("ts_us"))
    hr = m.groupBy("house", "hr").agg(F.sum("w").alias("s")).groupBy("house").agg(F.max_by("hr", "s").alias("argmax_hour"))
    b = m.select("house", F.floor(F.col("w") / 5).alias("b")).distinct().groupBy("house").agg(F.count(F.lit(1)).alias("n_bins"))
    return hr.join(b, "house").select("*", SC.state_bit(F.col("house").cast("int"), 0).alias("d0"), SC.state_bit(F.col("house").cast("int"), 1).alias("d1"))


@query("f05_json_and_units", "k:i n:i same_us:b", sql="SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, count(*) AS n, true AS same_us FROM events GROUP BY 1")
def f05(t):
    """JSON maps, and epoch numbers in s, ms, us or ns brought to one unit."""
    kv = F.from_json("props", "map<string,bigint>")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    mixed = F.when(F.col("event_id") % 3 == 0, ts * 1000).when(F.col("event_id") % 3 == 1, ts).otherwise(F.floor(ts / 1000))
    d = t.events.select(kv["k"].alias("k"), (F.abs(SC.epoch_unit_us(mixed) - ts) <= 1000).alias("ok"))
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("same_us"))


# ---------------------------------------------------------------- waveforms: each part-supplier series as a capture

WAVE_SQL = """
cap AS (SELECT l_suppkey AS capture, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS idx, l_quantity - 25.5 AS v, (l_discount - 0.05) * 100 AS i FROM lineitem),
cyc AS (SELECT capture, idx // 50 AS cycle, avg(v * i) AS power_w, max(abs(i)) AS env, max(abs(v)) < 24.5 AS clean FROM cap GROUP BY 1, 2 HAVING count(*) = 50)"""


def captures(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    month = F.date_format("l_shipdate", "yyyyMM").cast("bigint")
    d = ordered_scan(t.lineitem.select("l_suppkey", *order), ["l_suppkey"], order, month, row_number="n")
    return d.select(F.col("l_suppkey").alias("capture"), (F.col("n") - 1).alias("idx"), (F.col("l_quantity") - 25.5).alias("v"), ((F.col("l_discount") - 0.05) * 100).alias("i"))


@query("v01_cycle_power", "capture:i cycle:i power_w:d env:d clean:b", ctes=WAVE_SQL, sql="SELECT * FROM cyc")
def v01(t):
    return V.cycles(captures(t), 50, 24.5)


V02_SQL = """
st AS (SELECT *, CASE WHEN capture % 3 = 0 THEN 'off-on' WHEN capture % 3 = 1 THEN 'on-off' ELSE 'steady' END AS status, max(cycle) OVER (PARTITION BY capture) + 1 AS n FROM cyc),
lim AS (SELECT *, max(env) OVER (PARTITION BY capture) AS me FROM st WHERE cycle >= CASE WHEN status = 'off-on' THEN floor(n * 0.35) ELSE 0 END AND cycle < CASE WHEN status = 'on-off' THEN floor(n * 0.65) ELSE n END),
sg AS (SELECT *, clean AND env > 0.3 * me AS strong, sum(CASE WHEN clean AND env > 0.3 * me THEN 1 ELSE 0 END) OVER (PARTITION BY capture) AS ns FROM lim),
kp AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY cycle) - 1 AS k, count(*) OVER (PARTITION BY capture) AS m FROM sg WHERE CASE WHEN ns >= 3 THEN strong ELSE clean END),
chosen AS (SELECT * FROM kp WHERE m >= 3 AND (m <= 8 OR floor(ceil(k * 7.0 / (m - 1)) * (m - 1) / 7.0) = k))"""


def chosen(t, cap):
    c = V.cycles(cap, 50, 24.5).withColumn("status", F.when(F.col("capture") % 3 == 0, "off-on").when(F.col("capture") % 3 == 1, "on-off").otherwise("steady"))
    return V.pick_cycles(c, head=0.35, tail=0.65, env_share=0.3, least=3, most=8)


@query("v02_cycle_choice", "capture:i cycle:i env:d", ctes=WAVE_SQL + "," + V02_SQL, sql="SELECT capture, cycle, env FROM chosen")
def v02(t):
    return chosen(t, captures(t))


V03_SQL = """
rot AS (SELECT c.capture, c.idx // 50 AS cycle, c.idx % 50 AS p, v, i, lead(v) OVER (PARTITION BY c.capture, c.idx // 50 ORDER BY c.idx) AS nv FROM cap c JOIN chosen h ON c.capture = h.capture AND c.idx // 50 = h.cycle),
zc AS (SELECT capture, cycle, min(p) AS z FROM rot WHERE v < 0 AND nv >= 0 GROUP BY 1, 2), nz AS (SELECT capture, count(*) AS n_cycles FROM zc GROUP BY 1 HAVING count(*) >= 2),
av AS (SELECT rot.capture, (p - z + 50) % 50 AS phase, avg(v) AS v, avg(i) AS i, any_value(n_cycles) AS n_cycles FROM rot JOIN zc ON rot.capture = zc.capture AND rot.cycle = zc.cycle JOIN nz ON nz.capture = rot.capture GROUP BY 1, 2)"""


@query("v03_sync_average", "capture:i phase:i v:d i:d n_cycles:i", ctes=WAVE_SQL + "," + V02_SQL + "," + V03_SQL, sql="SELECT * FROM av")
def v03(t):
    cap = captures(t)
    return V.sync_average(cap, chosen(t, cap), 50, least=2)


@query("v04_harmonics", "capture:i h:i db:d3", ctes=WAVE_SQL + "," + V02_SQL + "," + V03_SQL, sql="""
WITH x AS (SELECT capture, phase, i - avg(i) OVER (PARTITION BY capture) AS x FROM av), m AS (SELECT capture, h, sqrt(pow(sum(x * cos(2 * pi() * h * phase / 50)), 2) + pow(sum(x * sin(2 * pi() * h * phase / 50)), 2)) AS mag FROM x, range(1, 13) r(h) GROUP BY 1, 2)
SELECT m.capture, m.h, 20 * log10(greatest(m.mag, 1e-12) / o.mag) AS db FROM m JOIN m o ON m.capture = o.capture AND o.h = 1""")
def v04(t):
    cap = captures(t)
    return V.harmonics(V.sync_average(cap, chosen(t, cap), 50, least=2), 12, 50)


@query("v04_distortion", "capture:i thd_pct:d3", ctes=WAVE_SQL + "," + V02_SQL + "," + V03_SQL, sql="""
WITH x AS (SELECT capture, phase, i - avg(i) OVER (PARTITION BY capture) AS x FROM av), m AS (SELECT capture, h, pow(sum(x * cos(2 * pi() * h * phase / 50)), 2) + pow(sum(x * sin(2 * pi() * h * phase / 50)), 2) AS m2 FROM x, range(1, 13) r(h) GROUP BY 1, 2)
SELECT capture, 100 * sqrt(sum(CASE WHEN h >= 2 THEN m2 ELSE 0 END)) / sqrt(sum(CASE WHEN h = 1 THEN m2 END)) AS thd_pct FROM m GROUP BY 1""")
def v04_thd(t):
    cap = captures(t)
    return V.distortion(V.harmonics(V.sync_average(cap, chosen(t, cap), 50, least=2), 12, 50))


@query("v05_meter_view", "capture:i sec:i power_w:d n:i", ctes=WAVE_SQL, sql="SELECT capture, cycle // 5 AS sec, avg(power_w) AS power_w, count(*) AS n FROM cyc GROUP BY 1, 2")
def v05(t):
    """Meter readings as means of cycle power."""
    return V.cycles(captures(t), 50, 24.5).groupBy("capture", bucket_of("cycle", 5).alias("sec")).agg(F.avg("power_w").alias("power_w"), F.count(F.lit(1)).alias("n"))
