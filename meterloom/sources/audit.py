"""Audits of raw columns, row order and layer agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import bucket_of, ordered_scan


def column_audit(df: DataFrame, columns: Sequence[str], n_samples: int = 4) -> DataFrame:
    """Per string column: rows, missing, junk (non-empty, non-numeric) and the
    first few distinct junk values in order."""
    tall = df.unpivot([], list(columns), "col", "v").withColumn("v", F.trim("v"))
    junk = (F.col("v") != "") & F.expr("try_cast(v as double)").isNull()
    c = tall.select("col", F.when(junk, F.col("v")).alias("_j"), (F.col("v").isNull() | (F.col("v") == "")).alias("_m"))
    per = c.groupBy("col", "_j").agg(F.count(F.lit(1)).alias("n"), F.count_if("_m").alias("m"))
    rank = ordered_scan(per.where("_j is not null"), ["col"], ["_j"], F.ascii("_j"), row_number="_r")
    few = rank.where(F.col("_r") <= n_samples).groupBy("col").agg(F.sort_array(F.collect_list("_j")).alias("samples"))
    out = per.groupBy("col").agg(F.sum("n").alias("n"), F.sum("m").alias("missing"),
                                 F.sum(F.when(F.col("_j").isNotNull(), F.col("n")).otherwise(0)).alias("junk"),
                                 F.count("_j").alias("n_distinct_junk"))
    return out.join(few, "col", "left")


def order_audit(df: DataFrame, keys: Sequence[str], index: str, ts: str, columns: Sequence[str], *,
                rows_per_chunk: int = 1 << 20) -> DataFrame:
    """Repeated and decreasing stamps in source order, and columns without any value."""
    d = ordered_scan(df, keys, [index], bucket_of(index, rows_per_chunk), lag={"_p": ts})
    nulls = [F.when(F.count(c) == 0, F.lit(c)) for c in columns]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ts) == F.col("_p")).alias("n_dup"),
                                F.count_if(F.col(ts) < F.col("_p")).alias("n_decreasing"),
                                F.concat_ws(",", *nulls).alias("all_null"))


def layer_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, first and last stamp and value sum of every key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"), F.sum("w").alias("s"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Compare two layer profiles; a key on one side only is a violation."""
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, list(keys), "full_outer")
    rows = F.coalesce(F.col("x.n") == F.col("y.n"), F.lit(False))
    ends = F.coalesce((F.col("x.t0") == F.col("y.t0")) & (F.col("x.t1") == F.col("y.t1")), F.lit(False))
    diff = F.abs(F.col("x.s") - F.col("y.s"))
    return j.select(*keys, rows.alias("rows_match"), ends.alias("ends_match"), diff.alias("sum_diff"),
                    (~rows | ~ends | F.coalesce(diff > tolerance, F.lit(True))).alias("violation"))
