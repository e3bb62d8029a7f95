"""Rows that arrive late: replay in arrival order, a side table, and the repair of what they change.

`split_late` sends a stream to two tables: rows behind the watermark to the side table, all others to the
on-time table that the online queries read. Its watermark is the newest stamp of the earlier batches less
`late_s`, read from a mark that every batch leaves, so that a batch that is run again decides as before;
each batch overwrites its own folders. `repair_sessions` is the batch job: it recomputes the sessions that
late rows touch from all readings and overwrites their day partitions, and may be run any number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import sessions, us
from ..operators.joins import points_in
from ..operators.ordered import DAY_US, bucket_of, merge_intervals
from ..session import cut_lineage, scratch_path
from .inorder import state_store
from .online import read_stream

HEARTBEAT_US = 400 * DAY_US  # how far behind the last reading the closing heartbeat is stamped


def arrivals(rows: DataFrame, arrival: str, parts: int, folder: str) -> Iterator[int]:
    """Append rows (ts, ts_us, w, ...) to a source folder in `parts` slices of arrival time, then a heartbeat
    without keys that moves the watermark past everything; yields after each."""
    spark = rows.sparkSession
    lo, hi, last = rows.agg(F.min(arrival), F.max(arrival), F.max("ts_us")).first()
    staged = scratch_path(spark, "arrivals")
    if lo is not None:
        part = F.floor((F.col(arrival) - lo) * parts / F.lit(float(hi - lo + 1))).cast("int")
        rows.withColumn("part", part).drop(arrival).write.partitionBy("part").parquet(staged)
        filled = spark.read.parquet(staged)
        for i in range(parts):
            filled.where(F.col("part") == i).drop("part").write.mode("append").parquet(folder)
            yield i
    stamp = (last or 0) + HEARTBEAT_US
    beat = {"ts": F.timestamp_micros(F.lit(stamp)), "ts_us": F.lit(stamp), "w": F.lit(1e300)}
    one = spark.range(1).select(*[beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != arrival])
    one.write.mode("append").parquet(folder)
    yield parts


def replay(rows: DataFrame, arrival: str, parts: int, rule: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming query gives when the rows arrive in slices, one run after each, and a closing heartbeat."""
    spark = rows.sparkSession
    source, out, check = (scratch_path(spark, f"{name}-{x}") for x in ("in", "out", "ck"))
    schema = rows.drop(arrival).schema
    for _ in arrivals(rows, arrival, parts, source):
        made = rule(read_stream(spark, source, schema))
        with state_store(spark):
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], check: str) -> None:
    """Process what there is; `write` gets every batch and its number."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def split_late(stream: DataFrame, folder: str, late_s: float) -> None:
    """Send every row to folder/ontime or folder/late, by batch; a row without a stamp is on time."""

    def write(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        try:
            before = spark.read.parquet(f"{folder}/marks/batch-{number - 1}").first()[0] if number else None
            behind = F.lit(False) if before is None else F.coalesce(F.col("ts_us") <= before // 1000 * 1000 - us(late_s), F.lit(False))
            batch.where(~behind).write.mode("overwrite").parquet(f"{folder}/ontime/batch-{number}")
            batch.where(behind).write.mode("overwrite").parquet(f"{folder}/late/batch-{number}")
            high = batch.agg(F.greatest(F.max("ts_us"), F.lit(before).cast("bigint")).alias("high"))
            high.write.mode("overwrite").parquet(f"{folder}/marks/batch-{number}")
        finally:
            batch.unpersist()

    to_batches(stream, write, f"{folder}/ck-split")


def online_sessions(folder: str, schema, make: Callable[[DataFrame], DataFrame], spark: SparkSession) -> None:
    """Run a streaming query over the on-time table; its rows go to folder/online, by batch."""
    made = make(read_stream(spark, f"{folder}/ontime/*", schema))
    to_batches(made, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/online/batch-{number}"), f"{folder}/ck-online")


def _put(rows: DataFrame, folder: str) -> None:
    rows.withColumn("day", bucket_of("t_on_us", DAY_US)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/served")


def served(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions as readers see them; a day from which all were taken holds one row without readings."""
    return spark.read.parquet(f"{folder}/served").where("n_rows > 0")


def publish(spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
    """Online sessions as day partitions of folder/served (by their start)."""
    _put(spark.read.parquet(f"{folder}/online/*").select(*keys, "t_on_us", "t_off_us", "n_rows"), folder)


def repair_sessions(spark: SparkSession, folder: str, keys: Sequence[str], thr: float, merge_s: float, *, order: str = "seq") -> None:
    """Bring folder/served to what all readings give, where late ones changed it.

    A late ON reading reaches sessions at most `merge_s` away; the hull of all that it links is
    computed anew from the readings inside, and the days where an old or a new session starts are overwritten.
    """
    keys = list(keys)
    on = lambda name: spark.read.parquet(f"{folder}/{name}/*").where((F.col("w") > thr) & F.coalesce(*keys).isNotNull()).select(*keys, "ts_us", F.col(order).alias("seq"))
    late, old = on("late"), served(spark, folder).select(*keys, "t_on_us", "t_off_us", "n_rows")
    reach = old.withColumn("a", F.col("t_on_us") - us(merge_s)).withColumn("z", F.col("t_off_us") + us(merge_s))
    touched = cut_lineage(points_in(late, reach, keys, start="a", end="z").select(*keys, "t_on_us", "t_off_us").distinct())
    hulls = touched.union(late.select(*keys, "ts_us", "ts_us")).distinct()
    hulls = cut_lineage(merge_intervals(hulls, keys, "t_on_us", "t_off_us", us(merge_s), overlapping=True).select(*keys, F.col("t_on_us").alias("a"), F.col("t_off_us").alias("z")))
    lo, hi = hulls.agg(F.min("a"), F.max("z")).first()
    if lo is None:
        return
    inside = points_in(on("ontime").union(late).where(F.col("ts_us").between(lo, hi)), hulls, keys, start="a", end="z")
    fresh = sessions(inside.select(*keys, "ts_us", "seq"), keys, merge_s).select(*keys, F.col("t0_us").alias("t_on_us"), F.col("t1_us").alias("t_off_us"), "n_rows")
    starts = touched.select("t_on_us").union(fresh.select("t_on_us")).select(bucket_of("t_on_us", DAY_US).alias("day")).distinct()
    kept = old.withColumn("day", bucket_of("t_on_us", DAY_US)).join(starts, "day", "left_semi").drop("day").join(touched, [*keys, "t_on_us", "t_off_us"], "left_anti")
    empty = starts.select(*[F.lit(None).cast(old.schema[k].dataType).alias(k) for k in keys], (F.col("day") * DAY_US).alias("t_on_us"), F.lit(None).cast("bigint").alias("t_off_us"), F.lit(0).cast("bigint").alias("n_rows"))
    _put(cut_lineage(kept.select(fresh.columns).union(fresh).union(empty)), folder)
