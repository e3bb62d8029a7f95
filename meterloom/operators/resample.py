"""Bucket resampling, dense grids, simultaneity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import us
from .ordered import bucket_of, join_dim


def bucket_resample(df: DataFrame, keys: Sequence[str], bucket_s: float, *, stamp: str = "start",
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Mean, max and count per fixed bucket; the stamp is the start or the midpoint."""
    b = us(bucket_s)
    g = df.groupBy(*keys, bucket_of("ts_us", b).alias("_b")).agg(
        F.avg("w").alias("w"), F.max("w").alias("w_max"), F.count("w").alias("n"),
        *[c.alias(n) for n, c in (extra or {}).items()])
    off = b // 2 if stamp == "mid" else 0
    return g.withColumn("ts_us", F.col("_b") * b + off).drop("_b").where("n > 0")


def dense_grid(df: DataFrame, keys: Sequence[str], bucket_s: float, *, fill: float | None = None,
               value: str = "w") -> DataFrame:
    """Every bucket between a key's first and last one; empty buckets are null or `fill`."""
    b = us(bucket_s)
    r = bucket_resample(df, keys, bucket_s).select(*keys, (F.col("ts_us") / b).cast("bigint").alias("_b"), "w")
    span = r.groupBy(*keys).agg(F.min("_b").alias("_a"), F.max("_b").alias("_z"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_z")).alias("_b"))
    out = grid.join(r, [*keys, "_b"], "left").withColumn("ts_us", F.col("_b") * b)
    w = F.col("w") if fill is None else F.coalesce("w", F.lit(float(fill)))
    return out.select(*keys, "ts_us", w.alias(value))


def simultaneity(df: DataFrame, house: Sequence[str], device: str, on: Column, bucket_s: float) -> DataFrame:
    """Share of the whole bucket grid with k devices ON (majority of a bucket's rows).

    Buckets without any reading count as zero devices ON; they are never
    materialised, their number follows from the span.
    """
    b = us(bucket_s)
    house = list(house)
    d = df.withColumn("_on", F.coalesce(on, F.lit(False)).cast("int"))
    span = d.groupBy(*house).agg(F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1"))
    d = join_dim(d, span, house)
    cell = (d.groupBy(*house, device, bucket_of(F.col("ts_us") - F.col("_t0"), b).alias("_b"))
            .agg(F.avg("_on").alias("_m")).where("_m > 0.5"))
    k = cell.groupBy(*house, "_b").agg(F.count(F.lit(1)).alias("k")).groupBy(*house, "k").agg(F.count(F.lit(1)).alias("n"))
    size = span.select(*house, (bucket_of(F.col("_t1") - F.col("_t0"), b) + 1).alias("n_buckets"))
    some = k.groupBy(*house).agg(F.sum("n").alias("_s"))
    zero = (size.join(some, house, "left").select(*house, F.lit(0).cast("bigint").alias("k"),
                                                  (F.col("n_buckets") - F.coalesce("_s", F.lit(0))).alias("n")))
    return (k.unionByName(zero).where("n > 0").join(size, house)
            .withColumn("share", F.col("n") / F.col("n_buckets")))
