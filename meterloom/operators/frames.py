"""Medians and maxima of time frames around marks.

Frames of dense series overlap: joining each mark with the rows of its frame makes (rows a frame) x (marks) rows, which grows
with the square of the density. Here every reading moves once for each time chunk its frames can reach, and a
chunk's marks are answered together: an order statistic of a range of rows by a wavelet matrix, a maximum by
doubled ranges. Both take n log n steps and memory of the chunk's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DAY_US, bucket_of, time_halo

#: output name -> (median | max | count, value column, first and last offset from the mark in microseconds, the last not included)
Frames = Mapping[str, tuple[str, str, int, int]]


def frame_stats(marks: DataFrame, readings: DataFrame, keys: Sequence[str], at: str, frames: Frames, *, ts: str = "ts_us",
                chunk_us: int = DAY_US // 4) -> DataFrame:
    """One row per distinct mark: keys, `at` and the statistics of its frames over the non-null values, null for empty
    frames (count: 0). Marks with a null key or stamp, which no reading equals, are left out."""
    keys = list(keys)
    values = list(dict.fromkeys(v for _, v, _, _ in frames.values()))
    back, ahead = max(0, *(-lo for _, _, lo, _ in frames.values())), max(0, *(hi - 1 for _, _, _, hi in frames.values()))
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in keys) or "true"
    r = time_halo(readings.where(known).select(*keys, F.col(ts).alias("_t"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]), "_t", chunk_us, back, ahead)
    r = r.select(*keys, "_chunk", "_t", F.lit(False).alias("_mark"), *[f"_v{i}" for i in range(len(values))])
    m = marks.where(known).select(*keys, F.col(at).alias("_t")).where("_t IS NOT NULL").distinct()
    m = m.select(*keys, bucket_of("_t", chunk_us).alias("_chunk"), "_t", F.lit(True).alias("_mark"), *[F.lit(None).cast("double").alias(f"_v{i}") for i in range(len(values))])
    plan = [(out, kind, f"_v{values.index(v)}", lo, hi) for out, (kind, v, lo, hi) in frames.items()]
    schema = ", ".join([*(f"`{c}` {readings.schema[c].dataType.simpleString()}" for c in keys), f"`{at}` bigint", *(f"`{p[0]}` double" for p in plan)])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["_mark"].to_numpy(dtype=bool)
        t = pdf["_t"].to_numpy(dtype=np.int64)
        mark = np.sort(t[asked])
        out = {c: np.repeat(pdf[c].to_numpy()[:1], len(mark)) for c in keys} | {at: mark}
        rows = {}
        for name, kind, col, lo, hi in plan:
            if col not in rows:
                v = pdf[col].to_numpy(dtype=float)
                own = np.flatnonzero(~asked & ~np.isnan(v))
                own = own[np.argsort(t[own], kind="stable")]
                rows[col] = t[own], v[own]
            at_, v = rows[col]
            a, z = np.searchsorted(at_, mark + lo), np.searchsorted(at_, mark + hi)
            out[name] = (z - a).astype(float) if kind == "count" else range_max(v, a, z) if kind == "max" else range_quantile(v, a, z, 0.5)
        return pd.DataFrame(out)

    got = r.unionByName(m).groupBy(*keys, "_chunk").applyInPandas(answer, schema)
    # pandas has no null doubles: an empty frame comes back as NaN
    return got.select(*keys, at, *[F.when(~F.isnan(p[0]), F.col(p[0])).alias(p[0]) for p in plan])


def range_max(v: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Largest of v[a:z] for arrays of bounds, NaN for empty ranges."""
    out = np.full(len(a), np.nan)
    n, level, best = z - a, 0, v
    while len(best) and (n >> level).any():
        here = (n >> level) == 1
        out[here] = np.maximum(best[a[here]], best[z[here] - (1 << level)])
        best = np.maximum(best[: -(1 << level)], best[1 << level:]) if len(best) > 1 << level else best[:0]
        level += 1
    return out


def range_quantile(v: np.ndarray, a: np.ndarray, z: np.ndarray, p: float) -> np.ndarray:
    """Linear-interpolation quantile of v[a:z] for arrays of bounds, NaN for empty ranges."""
    out = np.full(len(a), np.nan)
    some = z > a
    if not some.any():
        return out
    lo, hi = a[some], z[some]
    pos = p * (hi - lo - 1)
    k = np.floor(pos).astype(np.int64)
    order = np.argsort(v, kind="stable")
    low, high = v[order][_kth_rank(order, np.r_[lo, lo], np.r_[hi, hi], np.r_[k, np.ceil(pos).astype(np.int64)]).reshape(2, -1)]
    out[some] = low + (high - low) * (pos - k)
    return out


def _kth_rank(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Rank (in all of the array) of the k-th smallest of each range: a wavelet matrix walked down bit by bit of the ranks."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found = np.zeros(len(lo), np.int64)
    for bit in reversed(range(max(1, int(len(order) - 1).bit_length()))):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~one)]
        z0, z1 = zeros[lo], zeros[hi]
        up = k >= z1 - z0  # the one looked for has this bit set
        found |= up.astype(np.int64) << bit
        k = np.where(up, k - (z1 - z0), k)
        lo, hi = np.where(up, zeros[-1] + lo - z0, z0), np.where(up, zeros[-1] + hi - z1, z1)
        rank = np.r_[rank[~one], rank[one]]
    return found
