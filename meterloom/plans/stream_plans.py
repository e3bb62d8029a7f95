"""Streaming queries run to completion over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators.quantiles import exact_quantiles
from ..session import scratch_path
from ..streaming import late as L
from ..streaming import online as ON
from .catalog import query
from .series_plans import H, hyst_sql, runs_sql


def stream(t):
    s = ON.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    ts = F.col("ts").cast("timestamp")
    return s.select((F.col("user_id") % 5).alias("house"), "event_type", ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), F.col("value").alias("w"), F.col("event_id").alias("seq"))


PARTS = 5


def arriving(t):
    """The events with a delay of 0 to 96 hours between stamp and arrival."""
    ts = F.col("ts").cast("timestamp")
    stamp = F.unix_micros(ts)
    return t.events.select((F.col("user_id") % 5).alias("house"), "event_type", ts.alias("ts"), stamp.alias("ts_us"), F.col("value").alias("w"), F.col("event_id").alias("seq"),
                           (stamp + F.col("event_id") * 7919 % 97 * 3600 * 1_000_000).alias("arrival"))


ARRIVING_SQL = """x AS (SELECT user_id % 5 AS house, value AS w, epoch_us(ts) AS ts_us, epoch_us(ts) + (event_id * 7919 % 97) * 3600000000 AS a FROM events),
b AS (SELECT min(a) AS lo, max(a) AS hi FROM x), s AS (SELECT x.*, (a - lo) * 5 // (hi - lo + 1) AS k FROM x, b), m AS (SELECT k, max(ts_us) AS high FROM s GROUP BY k),
h AS (SELECT k, max(high) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM m)"""


@query("r01_stream_bucket_means", "house:i ts_us:i w:d w_max:d n:i", views="mains", sql="""
SELECT house, b * 3600000000 AS ts_us, w, w_max, n FROM (SELECT house, ts_us // 3600000000 AS b, avg(w) AS w, max(w) AS w_max, count(*) AS n FROM mains GROUP BY 1, 2) WHERE (b + 1) * 3600000000 <= (SELECT max(ts_us) FROM mains) - 600000000""")
def r01(t):
    return ON.run_to_table(ON.bucket_means(stream(t), ["house"], "1 hour"), "r01")


@query("r02_stream_sessions", "house:i t_on_us:i t_off_us:i n_rows:i", views="mains", sql="""
WITH a AS (SELECT house, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY house ORDER BY ts_us) <= 3600000000 THEN 0 ELSE 1 END AS brk FROM mains WHERE w > 60), b AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us) AS g FROM a)
SELECT house, min(ts_us) AS t_on_us, max(ts_us) AS t_off_us, count(*) AS n_rows FROM b GROUP BY house, g HAVING max(ts_us) - min(ts_us) >= 600000000 AND max(ts_us) + 3600000000 <= (SELECT max(ts_us) FROM mains WHERE w > 60) - 600000000""")
def r02(t):
    return ON.run_to_table(ON.on_sessions(stream(t), ["house"], 60.0, "1 hour", min_dwell_s=600), "r02")


@query("r03_stream_hysteresis", "house:i t_on_us:i t_off_us:i n_rows:i", views="mains", ctes=hyst_sql("mains", "house", "w >= 50", "w <= 25", n="hs") + "," + runs_sql("hs_b", "house", "on_state = 1", name="sr"), sql="""
SELECT house, t_on_us, t_off_us, n_rows FROM sr WHERE state = 1""")
def r03(t):
    """All episodes of rows that arrive up to four days late, in five slices; the last ones are closed by the timer."""
    rule = lambda s: ON.hysteresis(s, ["house"], 50.0, 25.0, idle_s=40 * 86400, late="97 hours", slot_s=86400, order="seq")
    return L.replay(arriving(t), "arrival", PARTS, rule, "r03")


@query("r04_stream_gaps", "house:i event_type:s last_us:i next_us:i", sql="""
SELECT house, event_type, last_us, next_us FROM (SELECT user_id % 5 AS house, event_type, epoch_us(ts) AS last_us, lead(epoch_us(ts)) OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS next_us FROM events) WHERE next_us - last_us > 14400000000""")
def r04(t):
    """Silent stretches that ended, whatever the order of arrival."""
    rule = lambda s: ON.gap_watchdog(s, ["house", "event_type"], 14400.0, late="97 hours", slot_s=86400)
    return L.replay(arriving(t), "arrival", PARTS, rule, "r04").where("next_us > 0")


@query("r05_stream_gate", "house:i n:i sum_w:d", sql="SELECT user_id % 5 AS house, count(*) AS n, sum(CAST(value AS DECIMAL(18, 6))) AS sum_w FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1")
def r05(t):
    """The stream joined with itself as duplicates: the gate keeps one of each event, also of events of one house, type and stamp.
    Gated values (0 to 200) are summed as decimals, so that the sum depends on no order."""
    s = stream(t)
    twice = s.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")
    return ON.run_to_table(ON.ingest_gate(twice, ["house", "event_type", "seq"], max_w=200.0), "r05").groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("decimal(18,6)")).alias("sum_w"))


@query("r06_stream_classify", "device:s n:i", sql="""
WITH p AS (SELECT user_id % 5 AS house, event_type AS device, quantile_cont(value, 0.9) AS l FROM events GROUP BY 1, 2), e AS (SELECT event_id, user_id % 5 AS house, value FROM events WHERE value > 60),
x AS (SELECT event_id, device, abs(value - l) / greatest(l, 1) AS d FROM e JOIN p ON e.house = p.house)
SELECT device, count(*) AS n FROM (SELECT event_id, min_by(device, (d, device)) AS device FROM x GROUP BY event_id) GROUP BY device""")
def r06(t):
    """Stream-static join: each large reading goes to the nearest profile level."""
    lib = exact_quantiles(t.channels, ["house", "device"], {"on_w": ("w", 0.9)})
    lib = lib.select("house", "device", "on_w", *[F.lit(60.0).alias(c) for c in ("dwell_p10_s", "dwell_p50_s", "dwell_p90_s")])
    ev = stream(t).where("w > 60").select("house", "ts_us", F.col("w").alias("level_w"), F.lit(60.0).alias("dwell_s"))
    return ON.run_to_table(C.classify_events(ev, lib, ["house"], ["ts_us"]).select("house", "ts_us", "device"), "r06").groupBy("device").agg(F.count(F.lit(1)).alias("n"))


@query("r07_stream_energy", "house:i energy_wh:d", views="mains", sql="""
SELECT house, sum(w * least(coalesce(nx - ts_us, 0), 3600000000)) / 3.6e9 AS energy_wh FROM (SELECT *, lead(ts_us) OVER (PARTITION BY house ORDER BY ts_us, seq) AS nx FROM mains) GROUP BY house""")
def r07(t):
    rule = lambda s: ON.running_energy(s, ["house"], 3600.0, late="97 hours", slot_s=86400, order="seq")
    return L.replay(arriving(t), "arrival", PARTS, rule, "r07").groupBy("house").agg(F.max("energy_wh").alias("energy_wh"))


@query("r08_late_rows", "house:i n_ontime:i n_late:i", "WITH " + ARRIVING_SQL + """
SELECT house, count(*) FILTER (WHERE NOT late) AS n_ontime, count(*) FILTER (WHERE late) AS n_late FROM (SELECT house, coalesce(ts_us <= high // 1000 * 1000 - 86400000000, false) AS late FROM s JOIN h USING (k)) GROUP BY house""")
def r08(t):
    """Rows of both tables when a day of delay is allowed and up to four happen."""
    folder, source, rows = scratch_path(t.spark, "r08"), scratch_path(t.spark, "r08-in"), arriving(t)
    for _ in L.arrivals(rows, "arrival", PARTS, source):
        L.split_late(ON.read_stream(t.spark, source, rows.drop("arrival").schema), folder, 86400)
    side = lambda name, late: t.spark.read.parquet(f"{folder}/{name}/*").where("house IS NOT NULL").select("house", F.lit(late).alias("late"))
    return side("ontime", False).union(side("late", True)).groupBy("house").agg(F.count_if(~F.col("late")).alias("n_ontime"), F.count_if("late").alias("n_late"))


@query("r09_late_repair", "house:i t_on_us:i t_off_us:i n_rows:i", views="mains", sql="""
WITH a AS (SELECT house, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY house ORDER BY ts_us) <= 3600000000 THEN 0 ELSE 1 END AS brk FROM mains WHERE w > 60), b AS (SELECT *, sum(brk) OVER (PARTITION BY house ORDER BY ts_us) AS g FROM a)
SELECT house, min(ts_us) AS t_on_us, max(ts_us) AS t_off_us, count(*) AS n_rows FROM b GROUP BY house, g""")
def r09(t):
    """Sessions found online from the rows on time, their day partitions repaired from the side table: as if no row had been late."""
    folder, source, rows = scratch_path(t.spark, "r09"), scratch_path(t.spark, "r09-in"), arriving(t)
    schema = rows.drop("arrival").schema
    for _ in L.arrivals(rows, "arrival", PARTS, source):
        L.split_late(ON.read_stream(t.spark, source, schema), folder, 86400)
        L.online_sessions(folder, schema, lambda s: ON.on_sessions(s, ["house"], 60.0, "1 hour", late="24 hours"), t.spark)
    L.publish(t.spark, folder, ["house"])
    L.repair_sessions(t.spark, folder, ["house"], 60.0, 3600.0)
    return L.served(t.spark, folder)
