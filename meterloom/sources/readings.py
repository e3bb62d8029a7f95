"""Adapters that turn tables into readings: keys, ts_us, seq, w."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import join_dim


def normalise_watts(w: Column, missing: Sequence[float] = ()) -> Column:
    """NaN and listed sentinel values become null; Spark would rank NaN above all."""
    w = w.cast("double")
    bad = F.isnan(w)
    if missing:
        bad = bad | w.isin([float(m) for m in missing])
    return F.when(~bad, w)


def read_series(spark: SparkSession, path: str, *, ts: str = "ts_us", value: str = "w",
                keys: Sequence[str] = (), t0_us: int | None = None, t1_us: int | None = None,
                missing: Sequence[float] = ()) -> DataFrame:
    """Project and range-filter a parquet table; both reach the scan."""
    df = spark.read.parquet(path)
    if t0_us is not None:
        df = df.where(F.col(ts) >= t0_us)
    if t1_us is not None:
        df = df.where(F.col(ts) < t1_us)
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.select(*keys, F.col(ts).alias("ts_us"), seq.alias("seq"),
                     normalise_watts(F.col(value), missing).alias("w"))


def drop_null_ts(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Rows without a stamp cannot be ordered; rows without a value stay."""
    return df.where(F.col(ts).isNotNull())


def unpivot_channels(df: DataFrame, ids: Sequence[str], columns: Sequence[str], *,
                     name: str = "channel", value: str = "w") -> DataFrame:
    """Wide table to long readings; the k-th column also gets its position `k`."""
    long = df.unpivot(list(ids), list(columns), name, value)
    pos = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i + 1))])
    return long.withColumn("k", pos[F.col(name)])


def mains_of(df: DataFrame, keys: Sequence[str], ts: str = "ts_us", w: str = "w") -> DataFrame:
    """Sum of all meters on the union of their stamps, missing values skipped."""
    return df.groupBy(*keys, ts).agg(F.sum(w).alias(w), F.count(w).alias("n_legs"))


def common_span(df: DataFrame, keys: Sequence[str], meter: str, ts: str = "ts_us") -> DataFrame:
    """Cut every meter of a group to the span all of them cover."""
    ends = (df.groupBy(*keys, meter).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
            .groupBy(*keys).agg(F.max("_a").alias("_t0"), F.min("_b").alias("_t1")))
    cut = join_dim(df, ends, keys)
    return cut.where(F.col(ts).between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")
