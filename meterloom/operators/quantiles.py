"""Exact quantiles whose state never grows with one group.

`percentile` keeps every distinct value of a group in one aggregation buffer.
Here values are counted first, ranked through a chunked running sum over value
buckets, and only the two neighbours of each wanted rank are picked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import as_col, join_dim, ordered_scan


def value_bucket(v: Column, per_octave: int = 64) -> Column:
    """Monotone bucket of a double: 64 buckets per power of two, both signs."""
    return (F.signum(v) * F.floor(per_octave * F.log2(F.lit(1.0) + F.abs(v) * 1e6))).cast("bigint")


def exact_quantiles(df: DataFrame, keys: Sequence[str],
                    spec: Mapping[str, tuple[str | Column, float]],
                    count: Mapping[str, str | Column] | None = None, *, per_octave: int = 64) -> DataFrame:
    """One row per key with linear-interpolation quantiles (nulls ignored).

    `spec` maps an output name to (input column, probability). Columns are
    ranked together in one pass; `count` maps outputs to the number of
    non-null values of a column. A task ranks the distinct values of a key in one bucket,
    `per_octave` of which make a power of two: few suit many keys of few values.
    """
    keys = list(keys)
    cols: dict[str, Column] = {}
    which: dict[str, int] = {}

    def slot(c):
        k = c if isinstance(c, str) else str(c)
        if k not in which:
            which[k] = len(cols)
            cols[k] = as_col(c)
        return which[k]

    wanted = [(out, slot(c), float(p)) for out, (c, p) in spec.items()]
    counts = [(out, slot(c)) for out, c in (count or {}).items()]
    one = len(cols) == 1
    vals = [F.struct(F.lit(i).alias("_k"), c.cast("double").alias("_v")) for i, c in enumerate(cols.values())]
    tall = (df.select(*keys, F.lit(0).alias("_k"), next(iter(cols.values())).cast("double").alias("_v")) if one
            else df.select(*keys, F.explode(F.array(*vals)).alias("_x")).select(*keys, "_x._k", "_x._v"))
    freq = (tall.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_k", "_v")
            .agg(F.count(F.lit(1)).alias("_n")))
    ranked = ordered_scan(freq, [*keys, "_k"], ["_v"], value_bucket(F.col("_v"), per_octave),
                          running_sum={"_hi": "_n"}, total={"_tot": "_n"})

    def at(i, k):
        """Value at zero-based index i of column slot k."""
        hit = (F.col("_k") == k) & (F.col("_hi") - F.col("_n") <= i) & (i < F.col("_hi"))
        return F.max(F.when(hit, F.col("_v")))

    aggs, final = [], []
    for j, (out, k, p) in enumerate(wanted):
        pos = F.lit(p) * (F.col("_tot") - 1)
        aggs += [at(F.floor(pos), k).alias(f"_l{j}"), at(F.ceil(pos), k).alias(f"_u{j}"),
                 F.max(F.when(F.col("_k") == k, pos - F.floor(pos))).alias(f"_f{j}")]
        final.append((F.col(f"_l{j}") + (F.col(f"_u{j}") - F.col(f"_l{j}")) * F.col(f"_f{j}")).alias(out))
    for out, k in counts:
        aggs.append(F.max(F.when(F.col("_k") == k, F.col("_tot"))).alias(f"_c_{out}"))
        final.append(F.coalesce(F.col(f"_c_{out}"), F.lit(0)).alias(out))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *final)


def with_quantiles(df: DataFrame, keys: Sequence[str],
                   spec: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """Rows of `df` with their group's quantiles attached (null when none exist)."""
    return join_dim(df, exact_quantiles(df, keys, spec), keys, "left")
