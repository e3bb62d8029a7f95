"""Waveform captures: cycle power, cycle choice, synchronous average, harmonics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .ordered import bucket_of, join_dim, ordered_scan

CYCLE = 500  # fixed value: samples of one mains cycle
CLEAN_V = 400.0  # fixed value: largest plausible voltage


def cycles(cap: DataFrame, size: int = CYCLE, clean_v: float = CLEAN_V) -> DataFrame:
    """Mean power, current envelope and clean flag of each whole cycle."""
    g = cap.groupBy("capture", bucket_of("idx", size).alias("cycle")).agg(
        F.avg(F.col("v") * F.col("i")).alias("power_w"), F.max(F.abs("i")).alias("env"), F.max(F.abs("v")).alias("vmax"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == size).select("capture", "cycle", "power_w", "env", (F.col("vmax") < clean_v).alias("clean"))


def pick_cycles(cyc: DataFrame, *, status: str = "status", head: float = 0.5, tail: float = 0.5, env_share: float = 0.5, least: int = 6, most: int = 40,
                cycles_per_chunk: int = 1 << 18) -> DataFrame:
    """Cycles of the settled part of a capture with enough current.

    An off-on capture keeps its later part, an on-off capture its earlier one.
    Fewer than `least` strong cycles fall back to all clean ones; more than
    `most` are thinned at even spacing.
    """
    cyc = cut_lineage(cyc)  # one row per cycle, read several times
    d = join_dim(cyc, cyc.groupBy("capture").agg((F.max("cycle") + 1).alias("_n")), ["capture"])
    lo = F.when(F.col(status).contains("off-on"), F.floor(F.col("_n") * head)).otherwise(F.lit(0))
    hi = F.when(F.col(status).contains("on-off"), F.floor(F.col("_n") * tail)).otherwise(F.col("_n"))
    d = d.where((F.col("cycle") >= lo) & (F.col("cycle") < hi))
    d = join_dim(d, d.groupBy("capture").agg(F.max("env").alias("_top")), ["capture"])
    d = d.withColumn("_strong", F.col("clean") & (F.col("env") > env_share * F.col("_top")))
    d = join_dim(d, d.groupBy("capture").agg(F.count_if("_strong").alias("_ns")), ["capture"])
    d = d.where(F.when(F.col("_ns") >= least, F.col("_strong")).otherwise(F.col("clean")))
    d = ordered_scan(d, ["capture"], ["cycle"], bucket_of("cycle", cycles_per_chunk), row_number="_k", total={"_m": F.lit(1)})
    d = d.withColumn("_k", F.col("_k") - 1).where(F.col("_m") >= least)
    # even spacing: keep k when it is floor(j * (m - 1) / (most - 1)) for some j
    j = F.ceil(F.col("_k") * (most - 1) / (F.col("_m") - 1))
    keep = (F.col("_m") <= most) | (F.floor(j * (F.col("_m") - 1) / (most - 1)) == F.col("_k"))
    return d.where(keep).select(*cyc.columns)


def sync_average(cap: DataFrame, chosen: DataFrame, size: int = CYCLE, least: int = 4) -> DataFrame:
    """Mean cycle after rotating each one to its first rising voltage zero."""
    d = cap.withColumn("cycle", bucket_of("idx", size)).withColumn("p", F.pmod("idx", F.lit(size)))
    d = d.join(chosen.select("capture", "cycle"), ["capture", "cycle"])
    d = d.withColumn("_nv", F.lead("v").over(W.partitionBy("capture", "cycle").orderBy("p")))
    z = d.where("v < 0 and _nv >= 0").groupBy("capture", "cycle").agg(F.min("p").alias("_z"))
    r = d.join(z, ["capture", "cycle"]).withColumn("phase", F.pmod(F.col("p") - F.col("_z"), F.lit(size)))
    n = z.groupBy("capture").agg(F.count(F.lit(1)).alias("n_cycles")).where(F.col("n_cycles") >= least)
    return r.groupBy("capture", "phase").agg(F.avg("v").alias("v"), F.avg("i").alias("i")).join(n, "capture")


def harmonics(avg: DataFrame, nh: int = 25, size: int = CYCLE) -> DataFrame:
    """Magnitude of harmonics 1..nh of the averaged current, in dB to the first."""
    avg = cut_lineage(avg)  # one cycle per capture
    m = avg.groupBy("capture").agg(F.avg("i").alias("_m"))
    d = avg.join(m, "capture").withColumn("_x", F.col("i") - F.col("_m")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(nh))))
    a = 2 * math.pi * F.col("h") * F.col("phase") / size
    s = d.groupBy("capture", "h").agg(F.sum(F.col("_x") * F.cos(a)).alias("c"), F.sum(F.col("_x") * F.sin(a)).alias("s"))
    s = s.withColumn("mag", F.sqrt(F.col("c") ** 2 + F.col("s") ** 2))
    one = s.where("h = 1").select("capture", F.col("mag").alias("_m1"))
    return s.join(one, "capture").select("capture", "h", "mag", (20 * F.log10(F.greatest("mag", F.lit(1e-12)) / F.col("_m1"))).alias("db"))


def distortion(har: DataFrame) -> DataFrame:
    """Total harmonic distortion in percent."""
    m2 = F.col("mag") ** 2
    return har.groupBy("capture").agg((100 * F.sqrt(F.sum(F.when(F.col("h") >= 2, m2).otherwise(0.0))) / F.sqrt(F.sum(F.when(F.col("h") == 1, m2)))).alias("thd_pct"))
