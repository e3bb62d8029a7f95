"""The episode, resampling and energy rules as streaming queries.

Every function takes a stream (or a batch) of readings with `ts` (timestamp),
`ts_us`, `w` and key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .inorder import US, Gaps, HoldEnergy, Hysteresis, in_order, state_store


def read_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything there is, append to parquet in the shared folder, read it back."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bucket_means(stream: DataFrame, keys: Sequence[str], bucket: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Mean, max and count per bucket once the watermark has passed it."""
    g = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", bucket).alias("_w")).agg(F.avg("w").alias("w"), F.max("w").alias("w_max"), F.count("w").alias("n"))
    return g.select(*keys, F.unix_micros("_w.start").alias("ts_us"), "w", "w_max", "n")


def on_sessions(stream: DataFrame, keys: Sequence[str], thr: Column | float, merge: str, *, min_dwell_s: float = 0.0, late: str = "10 minutes") -> DataFrame:
    """ON readings closer than `merge` form one episode, emitted when it can no longer grow."""
    on = stream.where(F.col("w") > thr).withWatermark("ts", late)
    g = on.groupBy(*keys, F.session_window("ts", merge).alias("_s")).agg(F.min("ts_us").alias("t_on_us"), F.max("ts_us").alias("t_off_us"), F.count(F.lit(1)).alias("n_rows"))
    return g.drop("_s").withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6).where(F.col("dur_s") >= min_dwell_s)


def hysteresis(stream: DataFrame, keys: Sequence[str], hi: float, lo: float, *, idle_s: float | None = None, late: str = "10 minutes",
               slot_s: float = 60.0, order: str | None = None) -> DataFrame:
    """Detector with an open episode as state; closes at a low reading, or after `idle_s` without any
    (an event-time timer closes the last one). Rows within `late` of the newest stamp may come in any order."""
    idle = None if idle_s is None else int(idle_s * US)
    return in_order(stream, keys, Hysteresis(hi, lo, idle), late=late, slot_s=slot_s, order=order)


def gap_watchdog(stream: DataFrame, keys: Sequence[str], gap_s: float, *, late: str = "10 minutes", slot_s: float = 60.0) -> DataFrame:
    """A row per silent stretch; one more by the timer, with next_us -1, for a stretch that lasts when the watermark has passed its length."""
    return in_order(stream, keys, Gaps(int(gap_s * US)), late=late, slot_s=slot_s)


def ingest_gate(stream: DataFrame, keys: Sequence[str], *, max_w: float = 23_000.0, late: str = "10 minutes") -> DataFrame:
    """Plausible readings only, one per (key, stamp) within the watermark."""
    ok = stream.where(F.col("w").isNotNull() & (F.col("w") >= 0) & (F.col("w") <= max_w))
    return ok.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "ts_us"])


def running_energy(stream: DataFrame, keys: Sequence[str], max_hold_s: float = 60.0, *, late: str = "10 minutes", slot_s: float = 60.0,
                   order: str | None = None) -> DataFrame:
    """Energy so far per key, one row per time slot in which the key had readings."""
    return in_order(stream, keys, HoldEnergy(int(max_hold_s * US)), late=late, slot_s=slot_s, order=order)
