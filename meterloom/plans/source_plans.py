"""Queries that run the text readers and sinks on lines derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.ordered import DAY_US, bucket_of
from ..session import scratch_path
from ..sources import store as ST
from ..sources import text as TX
from ..sources.readings import common_span, read_series
from .catalog import query
from .misc_plans import LAB_SQL, part_labels
from .series_plans import CH, CHANNEL_EP, H, channel_episodes


def us_col():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("s01_whitespace_table", "ts_us:i v0:d v1:d bad:i", sql="""
SELECT epoch_us(ts) AS ts_us, CASE WHEN event_id % 100 = 0 THEN NULL ELSE value END AS v0, user_id AS v1, CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END AS bad FROM events""")
def s01(t):
    sec = (us_col() / 1e6).cast("decimal(20,6)").cast("string")
    lines = t.events.select(F.concat_ws("  ", sec, F.when(F.col("event_id") % 100 == 0, "bad").otherwise(F.col("value").cast("string")), F.col("user_id").cast("string")).alias("value"))
    return TX.parse_dat(lines, 2)


@query("s02_csv_round_trip", "house:i n:i sum_w:d", sql="SELECT user_id % 5 AS house, count(*) AS n, sum(value) AS sum_w FROM events GROUP BY 1")
def s02(t):
    """Write a headed CSV with an odd time name, read it back by column resolution."""
    path = scratch_path(t.spark, "csv")
    sec = (us_col() / 1e6).cast("decimal(20,6)").cast("string")
    t.events.select(sec.alias("UNIX_TS"), F.col("value").alias("Aggregate"), (F.col("user_id") % 5).alias("House")).write.option("header", True).csv(path)
    d = TX.read_unix_csv(t.spark, path)
    return d.groupBy(F.col("House").cast("bigint").alias("house")).agg(F.count("ts_us").alias("n"), F.sum("Aggregate").alias("sum_w"))


@query("s03_time_decision", "name:s decision:s", sql="""
WITH u AS (SELECT 'sec' AS name, CAST(epoch_us(ts) / 1e6 AS VARCHAR) AS v FROM events UNION ALL SELECT 'iso', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events UNION ALL SELECT 'small', user_id || 'u' FROM events)
SELECT name, CASE WHEN avg(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.999 AND median(abs(TRY_CAST(v AS DOUBLE))) > 1e8 THEN 'seconds'
 WHEN avg(CASE WHEN TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.999 THEN 'datetime' ELSE 'none' END AS decision FROM u GROUP BY name""")
def s03(t):
    d = t.events.select((us_col() / 1e6).cast("decimal(20,6)").cast("string").alias("sec"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("iso"),
                        F.concat(F.col("user_id").cast("string"), F.lit("u")).alias("small"))
    return TX.time_decision(d, ["sec", "iso", "small"]).withColumnRenamed("column", "name")


@query("s04_typing_policy", "name:s n_bad:i numeric_ok:b", sql="""
WITH u AS (SELECT 'value' AS name, CAST(value AS VARCHAR) AS v FROM events UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'mixed', CASE WHEN event_id % 50 = 1 THEN 'n/a' ELSE CAST(value AS VARCHAR) END FROM events)
SELECT name, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL) AS n_bad, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL) = 0 AS numeric_ok FROM u GROUP BY name""")
def s04(t):
    d = t.events.select(F.col("value").cast("string").alias("value"), "event_type", F.when(F.col("event_id") % 50 == 1, "n/a").otherwise(F.col("value").cast("string")).alias("mixed"))
    return TX.typing_policy(d, ["value", "event_type", "mixed"]).withColumnRenamed("column", "name").withColumnRenamed("numeric", "numeric_ok")


@query("s05_strict_measurements", "n:i sum_w:d", sql="SELECT count(*) AS n, sum(value) AS sum_w FROM events")
def s05(t):
    lines = t.events.select(F.concat_ws(" ", F.col("event_id").cast("string"), F.col("value").cast("string")).alias("value"))
    return TX.strict(TX.parse_dat(lines, 1)).agg(F.count(F.lit(1)).alias("n"), F.sum("v0").alias("sum_w"))


@query("s06_day_files", "path:s ts_us:i powerallphases:d col_1:d", sql="""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, value, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id || '/' || d || '.csv' AS path, epoch_us(CAST(d AS TIMESTAMP)) + i * 1000000 AS ts_us, value AS powerallphases, CASE WHEN event_id % 2 = 0 THEN event_id END AS col_1 FROM a""")
def s06(t):
    """Day files rebuilt from the stream, with a ragged second column (`col_1`)."""
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", F.col("value").cast("string"), F.col("event_id").cast("string"))).otherwise(F.col("value").cast("string"))
    day = F.to_date("ts")
    files = t.events.select("user_id", day.alias("d"), F.struct("ts", "event_id", line.alias("l")).alias("x")).groupBy("user_id", "d").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one day of one meter
    files = files.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("d").cast("string"), F.lit(".csv")).alias("path"), F.array_join(F.transform("xs", lambda x: x["l"]), "\n").alias("content"))
    return TX.parse_day_files(files, 2)


@query("s08_day_matrix", "house:i ts_us:i occupancy:i", sql="""
WITH h AS (SELECT user_id % 5 AS house, CAST(ts AS DATE) AS d, hour(ts) AS hr FROM events WHERE event_type = 'signup'), d AS (SELECT DISTINCT house, d FROM h)
SELECT d.house, epoch_us(CAST(d.d AS TIMESTAMP)) + r.x * 3600000000 AS ts_us, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.house = d.house AND h.d = d.d AND h.hr = r.x) THEN 1 ELSE 0 END AS occupancy FROM d, range(24) r(x)""")
def s08(t):
    h = t.events.where("event_type = 'signup'").groupBy((F.col("user_id") % 5).alias("house"), F.to_date("ts").alias("d")).agg(F.collect_set(F.hour("ts")).alias("hs"))  # 24 values
    m = h.select("house", "d", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda x: F.array_contains("hs", x).cast("int").cast("string")), ",").alias("value"))
    return TX.parse_day_matrix(m, "d", "value", H)


def block_lines(t):
    """A file per house: a header before every 50th event id, its columns alternate."""
    e = t.events.select((F.col("user_id") % 5).alias("house"), "event_id", us_col().alias("us"), "value")
    two = F.floor(F.col("event_id") / 50) % 2 == 0
    sec = F.when(F.col("event_id") % 211 == 0, "oops").otherwise((F.col("us") / 1e6).cast("decimal(20,6)").cast("string"))
    v = F.when(F.col("event_id") % 13 == 0, "NULL").otherwise(F.col("value").cast("string"))
    row = F.when(two & (F.col("event_id") % 17 != 0), F.concat_ws(",", sec, v, F.col("event_id").cast("string"))).otherwise(F.concat_ws(",", sec, v))
    body = e.select("house", (F.col("event_id") * 2 + 1).alias("line"), row.alias("value"))
    blocks = e.groupBy("house", F.floor(F.col("event_id") / 50).alias("b")).agg(F.min("event_id").alias("m"))
    head = blocks.select("house", (F.col("m") * 2).alias("line"), F.when(F.col("b") % 2 == 0, "timestamp,aa,bb").otherwise("timestamp,aa").alias("value"))
    return body.unionByName(head)


BLOCK_SQL = """
e AS (SELECT user_id % 5 AS house, event_id, (event_id // 50) % 2 = 0 AS two, CASE WHEN event_id % 211 = 0 THEN NULL ELSE epoch_us(ts) END AS ts_us, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events),
blk AS (SELECT house, event_id * 2 + 1 AS line, ts_us, 'aa' AS meter, v AS w, two AND event_id % 17 = 0 AS ragged FROM e UNION ALL
 SELECT house, event_id * 2 + 1, ts_us, 'bb', CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id END, event_id % 17 = 0 FROM e WHERE two)"""


@query("s09_block_files", "house:i line:i ts_us:i meter:s w:d ragged:b", ctes=BLOCK_SQL, sql="SELECT * FROM blk")
def s09(t):
    return TX.parse_blocks(block_lines(t), ["house"], "line", lines_per_chunk=2048)


@query("s10_union_of_columns", "house:i ts_us:i aa:d bb:d", ctes=BLOCK_SQL, sql="SELECT house, ts_us, max(CASE WHEN meter = 'aa' THEN w END) AS aa, max(CASE WHEN meter = 'bb' THEN w END) AS bb FROM blk WHERE ts_us IS NOT NULL GROUP BY 1, 2")
def s10(t):
    long = TX.parse_blocks(block_lines(t), ["house"], "line", lines_per_chunk=2048).where("ts_us is not null")
    return TX.widen(long, ["house"], ["aa", "bb"])


@query("a48_block_audit", "house:i n_headers:i n_degenerate:i n_bad_ts:i n_null_cells:i", sql="""
SELECT user_id % 5 AS house, count(DISTINCT event_id // 50) AS n_headers, 0 AS n_degenerate, count(*) FILTER (event_id % 211 = 0) AS n_bad_ts, count(*) FILTER (event_id % 13 = 0) AS n_null_cells FROM events GROUP BY 1""")
def a48(t):
    return TX.block_audit(block_lines(t), ["house"])


def wider_lines(t):
    """Every nineteenth line has one cell more."""
    event = F.floor(F.col("line") / 2)
    return block_lines(t).withColumn("value", F.when(~F.col("value").startswith("timestamp") & (event % 19 == 0), F.concat("value", F.lit(",7"))).otherwise(F.col("value")))


@query("a48_ragged_lines", "house:i n_lines:i n_ragged:i", sql="""
SELECT user_id % 5 AS house, count(*) AS n_lines, count(*) FILTER (event_id % 19 = 0 AND (event_id // 50 % 2 = 1 OR event_id % 17 <> 0)) AS n_ragged FROM events GROUP BY 1""")
def a48_ragged(t):
    return TX.ragged_lines(wider_lines(t), ["house"], "line", lines_per_chunk=2048)


@query("a48_column_nulls", "house:i col:s n:i nulls:i junk:i", sql="""
WITH e AS (SELECT user_id % 5 AS house, event_id, event_id // 50 % 2 = 0 AS two, event_id % 17 <> 0 AS full_, event_id % 19 = 0 AS more FROM events)
SELECT house, 'aa' AS col, count(*) AS n, count(*) FILTER (event_id % 13 = 0) AS nulls, 0 AS junk FROM e GROUP BY 1
UNION ALL SELECT house, 'bb', count(*), 0, 0 FROM e WHERE two AND (full_ OR more) GROUP BY 1
UNION ALL SELECT house, '<ragged>', count(*), 0, 0 FROM e WHERE more AND (NOT two OR full_) GROUP BY 1""")
def a48_columns(t):
    return TX.block_columns(wider_lines(t), ["house"], "line", lines_per_chunk=2048)


@query("s11_parquet_sink", "house:i rows:i ts_min_us:i ts_max_us:i w_nulls:i", views="mains", sql="SELECT house, count(*) AS rows, min(ts_us) AS ts_min_us, max(ts_us) AS ts_max_us, 0 AS w_nulls FROM mains GROUP BY house")
def s11(t):
    path = scratch_path(t.spark, "series")
    ST.write_series(t.mains, path, ["house"], sort=["ts_us"])
    return ST.series_profile(t.spark.read.parquet(path), ["house"])


@query("s12_projected_scan", "n:i sum_w:d", sql="SELECT count(*) AS n, sum(l_quantity) AS sum_w FROM lineitem")
def s12(t):
    return t.lineitem.select("l_shipdate", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_w"))


@query("s13_range_scan", "house:i n:i", views="mains", sql="SELECT house, count(*) AS n FROM mains WHERE ts_us >= 1704844800000000 AND ts_us < 1705449600000000 GROUP BY house")
def s13(t):
    """Written sorted, read back with a stamp range the scan can use."""
    path = scratch_path(t.spark, "range")
    ST.write_series(t.mains, path, ["house"], sort=["ts_us"])
    return read_series(t.spark, path, keys=["house"], t0_us=1704844800000000, t1_us=1705449600000000).groupBy("house").agg(F.count(F.lit(1)).alias("n"))


@query("s14_layer_profile", "rows:i first_key:i last_key:i null_dates:i", sql="SELECT count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) FILTER (o_orderdate IS NULL) AS null_dates FROM orders")
def s14(t):
    """From the files' footers: the scan reads no column."""
    p = ST.footer_profile(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey"], ["o_orderdate"])
    return p.select("rows", F.col("min_o_orderkey").alias("first_key"), F.col("max_o_orderkey").alias("last_key"), F.col("nulls_o_orderdate").alias("null_dates"))


def export(t):
    """Wide export in source order: aggregate and two appliances on an event's stamp."""
    on = lambda d: F.when(F.col("event_type") == d, F.col("value")).otherwise(0.0).cast("string")
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").cast("string").alias("active_power_W"), on("click").alias("kettle_power_W"),
                           on("view").alias("fridge_power_w"), F.lit("0").alias("oven_on"), F.lit("1").alias("heater_W"))


@query("s15_discovered_export", "meter:s n:i sum_w:d", sql="""
SELECT 'mains' AS meter, count(*) AS n, sum(value) AS sum_w FROM events UNION ALL SELECT 'kettle', count(*), sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) FROM events UNION ALL SELECT 'fridge', count(*), sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) FROM events""")
def s15(t):
    return TX.appliance_readings(export(t).drop("event_id")).groupBy("meter").agg(F.count("ts_us").alias("n"), F.sum("w").alias("sum_w"))


@query("m38_schema_check", "code:s n:i", sql="""
WITH a AS (SELECT date_trunc('second', ts) AS s, event_id FROM events), l AS (SELECT s, lag(s) OVER (ORDER BY event_id) AS p FROM a)
SELECT 'flag without a power column' AS code, 1 AS n UNION ALL SELECT 'power-like column ignored', 1 UNION ALL SELECT * FROM (SELECT 'duplicate stamps' AS code, CAST(count(*) - count(DISTINCT s) AS BIGINT) AS n FROM a) WHERE n > 0
UNION ALL SELECT * FROM (SELECT 'stamps not increasing', count(*) AS n FROM l WHERE s < p) WHERE n > 0 UNION ALL SELECT * FROM (SELECT 'median power looks like kW', CASE WHEN quantile_cont(value, 0.5) < 20 THEN 1 ELSE 0 END AS n FROM events) WHERE n > 0""")
def m38(t):
    return TX.schema_check(export(t), index="event_id")


@query("s16_annotation_store", "provenance:s n:i dur_s:d", views="channels", ctes=CHANNEL_EP, sql="SELECT CASE WHEN house < 2 THEN 'manual' ELSE 'rule' END AS provenance, count(*) AS n, sum((t_off_us - t_on_us) / 1e6) AS dur_s FROM ep GROUP BY 1")
def s16(t):
    """Write both mark files, read them as one store; a third path does not exist."""
    root = scratch_path(t.spark, "marks")
    ep = channel_episodes(t)
    ST.write_table_csv(ep.where("house < 2").select("device", "t_on_us", "t_off_us", F.lit("manual_x").alias("source"), F.col("house").cast("string").alias("house")), root + "/manual")
    ST.write_table_csv(ep.where("house >= 2").select("device", "t_on_us", "t_off_us", "dur_s", "energy_wh", F.lit("rule_x").alias("source")), root + "/rule")
    m = ST.read_marks(t.spark, root + "/manual", root + "/rule").unionByName(ST.read_marks(t.spark, root + "/none", root + "/none2"))
    return m.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t_off_us") - F.col("t_on_us")) / 1e6).alias("dur_s"))


@query("s17_store_writers", "house:i n:i energy_wh:d3", views="channels", ctes=CHANNEL_EP, sql="SELECT house, count(*) AS n, sum(energy_wh) AS energy_wh FROM ep GROUP BY house")
def s17(t):
    path = scratch_path(t.spark, "rules")
    ST.write_table_csv(channel_episodes(t).select("house", "device", "t_on_us", "t_off_us", "dur_s", "energy_wh"), path, ["house"])
    d = t.spark.read.schema("device string, t_on_us bigint, t_off_us bigint, dur_s double, energy_wh double, house bigint").option("header", True).csv(path)
    return d.groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.sum("energy_wh").alias("energy_wh"))


@query("s18_threshold_merge", "house:i device:s thr_on_w:d source:s", views="channels", sql="""
SELECT house, device, CASE WHEN house < 2 THEN avg(w) ELSE median(w) END AS thr_on_w, CASE WHEN house < 2 THEN 'new' ELSE 'old' END AS source FROM channels GROUP BY 1, 2""")
def s18(t):
    """Merge new threshold records over the stored JSON ones."""
    from ..operators.quantiles import exact_quantiles

    path = scratch_path(t.spark, "thr")
    old = exact_quantiles(t.channels, ["house", "device"], {"thr_on_w": ("w", 0.5)}).withColumn("source", F.lit("old"))
    ST.write_json(old, path)
    new = t.channels.where("house < 2").groupBy("house", "device").agg(F.avg("w").alias("thr_on_w")).withColumn("source", F.lit("new"))
    return ST.merge_records(t.spark.read.schema(old.schema).json(path), new, ["house", "device"])


@query("s18_label_map_json", "building:i n_meters:i n_canonical:i", ctes=LAB_SQL, sql="SELECT building, count(*) AS n_meters, count(canonical) AS n_canonical FROM lab GROUP BY building")
def s18_labels(t):
    j = L.label_json(part_labels(t), ["building"], F.struct("label", "canonical"))
    m = F.from_json("json", "map<string,struct<label:string,canonical:string>>")
    return j.select("building", m.alias("m")).select("building", F.size("m").alias("n_meters"), F.size(F.filter(F.map_values("m"), lambda x: x["canonical"].isNotNull())).alias("n_canonical"))


@query("s20_common_span", "house:i n:i t0:i t1:i", views="channels", sql="""
WITH s AS (SELECT house, device, min(ts_us) AS a, max(ts_us) AS b FROM channels GROUP BY 1, 2), c AS (SELECT house, max(a) AS a, min(b) AS b FROM s GROUP BY 1)
SELECT c.house, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1 FROM channels x JOIN c ON x.house = c.house WHERE ts_us BETWEEN a AND b GROUP BY c.house""")
def s20(t):
    d = common_span(t.channels, ["house"], "device")
    return d.groupBy("house").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))


@query("s07_ragged_columns", "n_lines:i n_extra:i extra_sum:d", sql="SELECT count(*) AS n_lines, count(*) FILTER (event_id % 3 = 0) AS n_extra, sum(CASE WHEN event_id % 3 = 0 THEN value END) AS extra_sum FROM events")
def s07(t):
    """Lines with one, two or three cells under one schema; extras are col_1, col_2."""
    v = F.col("value").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat_ws(",", v, v, v)).when(F.col("event_id") % 3 == 1, F.concat_ws(",", v, v)).otherwise(v)
    files = t.events.select(F.concat(F.lit("2024-01-01/"), F.col("event_id").cast("string")).alias("path"), line.alias("content"))
    d = TX.parse_day_files(files, 3)
    return d.agg(F.count(F.lit(1)).alias("n_lines"), F.count("col_2").alias("n_extra"), F.sum("col_2").alias("extra_sum"))


@query("s19_report_lines", "pos:i line:s", sql="""
SELECT 0 AS pos, '| house | rows |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 2 + user_id % 5, '| ' || (user_id % 5) || ' | ' || count(*) || ' |' FROM events GROUP BY user_id % 5""")
def s19(t):
    """A report as lines: the aggregate is small before it is rendered."""
    g = t.mains.groupBy("house").agg(F.count(F.lit(1)).alias("rows"))
    return ST.report_lines(g, ["house", "rows"], "house")
