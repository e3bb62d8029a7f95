"""Top-n, thinning, subsampling, bootstrap, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import DAY_US, bucket_of, join_dim, ordered_scan
from .quantiles import exact_quantiles


def top_n(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First n rows of each group; Spark keeps only n rows per partition before the shuffle."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).withColumnRenamed("_k", "rank")


def first_n(df: DataFrame, by: Sequence[str], ts: str, n: int, *, chunk_us: int = 32 * DAY_US) -> DataFrame:
    return ordered_scan(df, by, [ts], bucket_of(ts, chunk_us), row_number="rank").where(F.col("rank") <= n)


def draw(size: Column, *parts) -> Column:
    """A whole number from 0 to size - 1, drawn by the MD5 of the parts as text, so that any engine draws the same."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") % size


def subsample(df: DataFrame, label: str, ident: str, n: int, seed: int) -> DataFrame:
    """n rows of each label in hash order, the same on every partitioning."""
    return top_n(df, [label], n, F.md5(F.concat_ws(":", F.lit(seed), F.col(ident)).cast("binary")), F.col(ident))


def bootstrap_medians(df: DataFrame, by: Sequence[str], ident: str, values: Sequence[str], sizes: Sequence[int], draws: int, seed: int) -> DataFrame:
    """5 / 50 / 95 % bands of the medians of n draws with replacement."""
    by = list(by)
    d = ordered_scan(df, by, [ident], bucket_of(ident, 1 << 20), row_number="_i", total={"_N": F.lit(1)})
    size = d.groupBy(*by).agg(F.max("_N").alias("_N"))
    s = (size.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
         .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1))))
    s = s.withColumn("_i", draw(F.col("_N"), seed, "n", "draw", "slot", *by) + 1)
    m = s.join(d.select(*by, "_i", *values), [*by, "_i"])
    med = m.groupBy(*by, "n", "draw").agg(*[F.percentile(v, 0.5).alias(v) for v in values])  # n values a draw
    spec = {f"{v}_p{p}": (v, p / 100) for v in values for p in (5, 50, 95)}
    return exact_quantiles(med, [*by, "n"], spec)


def split_at(df: DataFrame, keys: Sequence[str], frac: float, *, fixed: dict | None = None) -> DataFrame:
    """Split stamp of each key: a fraction of the span floored to UTC midnight,
    or a fixed stamp by key value."""
    keys = list(keys)
    s = df.groupBy(*keys).agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_z"))
    cut = bucket_of(F.col("_a") + F.floor(frac * (F.col("_z") - F.col("_a"))), DAY_US) * DAY_US
    for value, ts in (fixed or {}).items():
        cut = F.when(F.col(keys[0]) == value, F.lit(ts)).otherwise(cut)
    return s.select(*keys, cut.cast("bigint").alias("split_us"))
