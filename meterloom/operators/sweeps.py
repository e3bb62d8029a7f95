"""Configuration sweeps: many detector settings as rows of one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import episodes as X
from . import matching as M
from .calibrate import clamp
from .ordered import DAY_US, bucket_of, join_dim, ordered_scan
from .stats import prf

# fixed values: the experiment registry (id, signature statistic, enter and exit
# fraction, least samples, merge in samples for detections and for truth, dwell
# prior, rolling baseline in rows, relative thresholds for levels under the floor)
EXPERIMENTS = (
    ("E00", "median", 0.50, 0.25, 2, 0, 0, False, 0, False),
    ("E01", "median", 0.50, 0.25, 2, 2, 2, False, 0, False),
    ("E02", "median", 0.50, 0.25, 2, 100, 100, False, 0, False),
    ("E03", "p25", 0.50, 0.25, 2, 0, 0, False, 0, False),
    ("E04", "p90", 0.50, 0.25, 2, 0, 0, False, 0, False),
    ("E05", "median", 0.25, 0.125, 2, 0, 0, False, 0, False),
    ("E06", "median", 0.50, 0.25, 2, 0, 0, True, 0, False),
    ("E07", "median", 0.50, 0.25, 2, 0, 0, False, 50, False),
    ("E08", "median", 0.50, 0.25, 2, 0, 0, False, 300, False),
    ("E09", "median", 0.50, 0.25, 2, 0, 0, False, 0, True),
    ("E10", "median", 0.40, 0.20, 2, 0, 0, False, 0, False),
    ("E11", "median", 0.60, 0.30, 2, 0, 0, False, 0, False),
    ("E12", "median", 0.50, 0.25, 3, 0, 0, False, 0, False),
    ("E13", "p25", 0.50, 0.25, 2, 2, 2, True, 0, False),
)
# fixed values: event-then-classify variants (id, margin, plausibility, dwell prior)
EVENT_EXPERIMENTS = (("E14", 0.0, False, False), ("E15", 1.3, False, False), ("E16", 0.0, False, False), ("E17", 0.0, True, False),
                     ("E18", 0.0, False, True), ("E19", 1.3, True, True))
MANY_METERS = 100_000  # floors of more are not broadcast
COLUMNS = ("exp string, stat string, enter double, exit double, min_rows int, merge_rows int, truth_merge_rows int, dwell_prior boolean, "
           "baseline_rows int, relative boolean")


def config_table(spark, ids: Sequence[str] | None = None) -> DataFrame:
    return spark.createDataFrame([e for e in EXPERIMENTS if ids is None or e[0] in ids], COLUMNS)


def detect_configs(mains: DataFrame, sig: DataFrame, floor: DataFrame, configs: Sequence[tuple], keys: Sequence[str], *, dt_s: float,
                   chunk_us: int = DAY_US, rows_per_chunk: int = 1 << 18) -> DataFrame:
    """Sample-unit detections of every (house, device, exp).

    Configurations that share a baseline window run as one job: a task holds one chunk of
    rows and the thresholds of its house, walks them for every (device, exp) and hands on the rows at
    which a detector turns on or off, so readings are copied for no configuration.
    """
    keys = list(keys)
    d = X.numbered(mains, keys, chunk_us)
    # a checkpointed table has no size estimate, and a join by key alone would put a whole meter into one task
    base_w = floor.select(*keys, "floor_w")
    d = d.join(F.broadcast(base_w) if floor.count() <= MANY_METERS else base_w, keys).withColumn("x", F.col("w") - F.col("floor_w"))
    sizes = mains.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    parts = []
    for win in sorted({c[8] for c in configs} | ({50} if any(c[9] for c in configs) else set())):
        cfg = [c for c in configs if c[8] == win or (c[9] and win == 50)]
        if not cfg:
            continue
        v = d
        if win:
            half = win // 2
            v = X.rolling(d.withColumnRenamed("i", "_i0"), keys, half, win - 1 - half, {"_med": F.percentile("x", 0.5)}, chunk_us=chunk_us,
                          rows_per_chunk=rows_per_chunk).withColumn("x", F.col("x") - F.col("_med")).drop("_i0", "_med")
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        table = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip([*names, "win"], [*c, win])]) for c in cfg]))
        p = F.when(F.col("stat") == "p25", F.col("on_p25_w")).when(F.col("stat") == "p90", F.col("on_p90_w")).otherwise(F.col("on_w"))
        weak = F.col("relative") & (F.col("on_w") < F.col("floor_w"))
        base = F.greatest("on_w", F.lit(5.0))
        s = (sig.join(floor.select(*keys, "floor_w"), keys).select("*", table.alias("_e")).select("*", "_e.*")
             .where((F.col("baseline_rows") == F.col("win")) | weak).where(~(weak & (F.col("win") == 0)))
             .withColumn("_p", p).where("_p > 0")
             .select(*keys, "device", "exp", "min_rows", "merge_rows", "dwell_prior", "dwell_p10_s", "dwell_p90_s",
                     F.when(weak, 0.5 * base).otherwise(F.col("enter") * F.col("_p")).alias("hi"), F.when(weak, 0.25 * base).otherwise(F.col("exit") * F.col("_p")).alias("lo")))
        ck = [*keys, "device", "exp"]
        turns = _turns(v, s.select(*ck, "hi", "lo").join(sizes, keys), keys, ck, rows_per_chunk)
        # inside a chunk levels alternate; its first row may repeat the state before, the next OFF row ends a run
        turns = ordered_scan(turns, ck, ["i"], bucket_of("i", 1 << 18), lag={"_was": "on"}, bfill={"_z": F.when(F.col("on") == 0, F.col("i"))})
        runs = turns.where("on = 1 AND coalesce(_was, 0) = 0").select(*ck, F.col("i").alias("i_on"), F.coalesce("_z", "n_all").alias("i_off"))
        runs = join_dim(runs, s.drop("hi", "lo"), ck).where(F.col("i_off") - F.col("i_on") >= F.col("min_rows")).withColumn("dwell_prior", F.col("dwell_prior").cast("int"))
        m = X.merge_intervals(runs, ck, "i_on", "i_off", F.col("merge_rows"), chunk_us=1 << 18,
                              aggs={c: ("max", F.col(c)) for c in ("dwell_prior", "dwell_p10_s", "dwell_p90_s")})
        # without merging, touching runs stay apart: the distance of distinct runs is at least one row
        dwell = (F.col("i_off") - F.col("i_on")) * dt_s
        fits = (F.col("dwell_prior") == 0) | (F.col("dwell_p90_s") <= 0) | dwell.between(0.5 * F.col("dwell_p10_s"), 2.0 * F.col("dwell_p90_s"))
        parts.append(m.where(fits).select(*ck, "i_on", (F.col("i_off") - F.col("i_on")).alias("n_samples")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _turns(v: DataFrame, levels: DataFrame, keys: Sequence[str], ck: Sequence[str], rows_per_chunk: int) -> DataFrame:
    """ck, i, on, n_all: of every detector and chunk of rows the decided rows (x >= hi: 1, x <= lo: 0) whose state is not that of
    the decided row before them in the chunk. `levels` has the thresholds and `n_all`, the number of rows of the key."""
    own = [c for c in ck if c not in keys]
    rows = v.select(*keys, bucket_of("i", rows_per_chunk).alias("_chunk"), "i", "x")
    per = levels.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), bucket_of(F.col("n_all") - 1, rows_per_chunk))))
    types = {**dict(v.dtypes), **dict(levels.dtypes)}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in ck), "i bigint", "on int", "n_all bigint"])

    def walk(part: pd.DataFrame, det: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        i, x, out = part["i"].to_numpy(), part["x"].to_numpy(dtype=float), []
        for d in det.itertuples(index=False) if len(part) else ():
            on = np.where(x >= d.hi, 1, np.where(x <= d.lo, 0, -1))
            at = np.flatnonzero(on >= 0)
            at = at[np.flatnonzero(np.diff(on[at], prepend=-1))]
            if len(at):
                out.append(pd.DataFrame({**{c: np.repeat(np.array([getattr(d, c)], dtype=object), len(at)) for c in (*keys, *own)}, "i": i[at], "on": on[at].astype(np.int32), "n_all": d.n_all}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=object) for c in (*ck, "i", "on", "n_all")})

    return rows.groupBy(*keys, "_chunk").cogroup(per.groupBy(*keys, "_chunk")).applyInPandas(walk, schema)


def leaderboard(truth: DataFrame, det: DataFrame, keys: Sequence[str], *, tol_rows: int = 2) -> DataFrame:
    """Mean F1 over devices with truth per experiment, and the delta to E00.

    Both sides: keys, exp, id, start, length (rows).
    """
    by = ["exp", *keys]
    m = M.match_best(truth, det, by, tol=tol_rows, bucket=1 << 6)  # few truths meet a detection's bucket
    s = M.score(truth, det, m, by).where("n_gt > 0")
    f = s.groupBy("exp").agg(F.avg("f1").alias("mean_f1"), F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("n_matched").alias("n_matched"))
    base = f.where("exp = 'E00'").select(F.col("mean_f1").alias("_b"))
    return f.join(F.broadcast(base), how="left").withColumn("delta", F.col("mean_f1") - F.col("_b")).drop("_b")  # one row


def with_ids(df: DataFrame, keys: Sequence[str], start: str, length: str) -> DataFrame:
    d = ordered_scan(df.select(*keys, F.col(start).alias("start"), F.col(length).alias("length")), keys, ["start", "length"], bucket_of("start", 1 << 18), row_number="id")
    return d


def noise_variant(w: Column, key: Column, *, above_w: float = 230.0, sd: float = 0.05, seed: int = 42) -> Column:
    """5 % Gaussian noise above `above_w`: a Box-Muller draw from two hashes of the
    row key, the same on every partitioning."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    return F.when(w > above_w, w * (1 + sd * z)).otherwise(w)


def floor_variant(w: Column, floor: float = 30.0) -> Column:
    """Readings under the meter's floor become 0."""
    return F.when(w < floor, 0.0).otherwise(w)
