"""Sequential drift statistics: exponentially weighted means and cumulative sums, carried over chunks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import as_col, ordered_scan


def ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str, alpha: float, *, chunk: Column,
         out: str = "ewma") -> DataFrame:
    """Rows with e = alpha * value + (1 - alpha) * e before; the first row of a key has e = value.

    `chunk` must not decrease along `order`. A stretch of rows maps the mean before it to the mean behind
    it by a straight line, and such maps compose: rows are scanned in blocks (short enough for the powers of
    1 - alpha), blocks are folded within a chunk and chunks within a key. Rows with a null value are left out.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    keys, order, r = list(keys), list(order), 1.0 - alpha
    block = max(1, min(64, int(-400 / math.log(r))))
    src = df.select("*", F.struct(*keys, F.lit(0).alias("_all")).alias("_key"), F.struct(chunk.cast("bigint").alias("n")).alias("_chunk"),
                    as_col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    place = F.row_number().over(W.partitionBy("_key", "_chunk").orderBy(*order)) - 1
    src = src.withColumn("_n", place).select("*", F.floor(F.col("_n") / block).alias("_block"), (F.col("_n") % block).alias("_i"))
    upto = W.partitionBy("_key", "_chunk", "_block").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(r), n)
    src = src.withColumn("_own", alpha * F.sum(F.col("_x") * power(-F.col("_i"))).over(upto) * power(F.col("_i")))
    line = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    blocks = src.groupBy("_key", "_chunk", "_block").agg(line(power(F.count(F.lit(1))), F.max_by("_own", "_i")).alias("m"), F.min_by("_x", "_i").alias("x"))

    def fold(items: Column, first: Column, name: str) -> Column:
        """What comes before each item, and what comes out of all."""
        none = F.slice(F.transform(items, lambda s: F.struct(s[name].alias(name), first.alias("m"))), 1, 0)
        step = lambda acc, s: F.struct(line(acc["m"]["a"] * s["m"]["a"], acc["m"]["b"] * s["m"]["a"] + s["m"]["b"]).alias("m"),
                                       F.concat(acc["out"], F.array(F.struct(s[name].alias(name), acc["m"].alias("m")))).alias("out"))
        return F.aggregate(items, F.struct(first.alias("m"), none.alias("out")), step)

    same = line(F.lit(1.0), F.lit(0.0))
    chunks = blocks.groupBy("_key", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_block", "m", "x"))).alias("s"))
    chunks = chunks.select("_key", "_chunk", fold(F.col("s"), same, "_block").alias("f"), F.col("s")[0]["x"].alias("x"))
    whole = chunks.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", F.col("f.m").alias("m"), "x"))).alias("s"))
    before = whole.select("_key", F.explode(fold(F.col("s"), line(F.lit(0.0), F.col("s")[0]["x"]), "_chunk")["out"]).alias("o"))
    before = before.select("_key", F.col("o._chunk").alias("_chunk"), F.col("o.m.b").alias("_e"))
    starts = chunks.select("_key", "_chunk", F.explode("f.out").alias("o")).select("_key", "_chunk", F.col("o._block").alias("_block"), F.col("o.m").alias("m"))
    starts = starts.join(before, ["_key", "_chunk"]).select("_key", "_chunk", "_block", (F.col("m.a") * F.col("_e") + F.col("m.b")).alias("_e"))
    got = src.join(starts, ["_key", "_chunk", "_block"])
    return got.select(*df.columns, (F.col("_own") + power(F.col("_i") + 1) * F.col("_e")).alias(out))


def cusum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str, *, chunk: Column, slack: float = 0.0,
          up: str = "cusum_up", down: str = "cusum_down") -> DataFrame:
    """Rows with s = max(0, s before + value - slack) and the same for -value.

    The recursion is the distance of a running sum from its lowest point so far (or from 0), so both are carried sums
    and maxima. A null value changes nothing.
    """
    cols, v = df.columns, F.coalesce(as_col(value).cast("double"), F.lit(0.0))
    gain = lambda sign: F.when(as_col(value).isNull(), 0.0).otherwise(sign * v - slack)
    d = ordered_scan(df.select("*", gain(1).alias("_u"), gain(-1).alias("_d")), keys, order, chunk, running_sum={"_pu": "_u", "_pd": "_d"})
    d = ordered_scan(d.select(*cols, "_pu", "_pd", (-F.col("_pu")).alias("_nu"), (-F.col("_pd")).alias("_nd")), keys, order, chunk, running_max={"_mu": "_nu", "_md": "_nd"})
    least = lambda p, m: F.col(p) + F.greatest(F.col(m), F.lit(0.0))
    return d.select(*cols, least("_pu", "_mu").alias(up), least("_pd", "_md").alias(down))
