"""ON runs, episodes, hysteresis detectors, activation runs, gaps and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import frame_stats
from .joins import last_before, next_after
from .ordered import (DAY_US, as_col, bucket_of, halo_window, islands, merge_intervals,
                      ordered_scan, row_halo)

S = 1_000_000
WUS_PER_WH = 3.6e9


def us(seconds: float) -> int:
    return int(round(seconds * S))


def state_runs(df: DataFrame, keys: Sequence[str], mark: Column, *, chunk_us: int = DAY_US,
               hold_s: float = 60.0, max_gap_s: float | None = None, initial: int = 0,
               extra: Mapping[str, Column | str] | None = None,
               aggs: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Runs of equal state in row order: state, t_on_us, t_off_us (last row of the
    run), next_us (row after it), n_rows, energy_wh by the hold rule.

    `mark` is 1 / 0 / null, null meaning undecided (keeps the previous state).
    Rows of one run may be far apart in time unless `max_gap_s` cuts them.
    """
    row = {"ts": "ts_us", **(extra or {})}
    brk = (lambda p, c: (c["ts"] - p["ts"]) > us(max_gap_s)) if max_gap_s is not None else None
    r = islands(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), row=row, mark=mark,
                initial=F.lit(initial), breaks=brk, aggs=aggs, hold=("w", us(hold_s)))
    return r.select(*keys, "state", F.col("first.ts").alias("t_on_us"), F.col("last.ts").alias("t_off_us"),
                    F.col("next").alias("next_us"), "n_rows", "first", "last",
                    (F.col("hold_wus") / WUS_PER_WH).alias("energy_wh"), *list(aggs or {}))


def on_mark(on: Column) -> Column:
    """A plain boolean as a mark: null counts as OFF."""
    return F.when(on, 1).otherwise(0)


def build_episodes(df: DataFrame, keys: Sequence[str], thr: Column | float, *,
                   min_dwell_s: float = 30.0, merge_gap_s: float = 12.0, max_hold_s: float = 60.0,
                   max_gap_s: float | None = None, chunk_us: int = DAY_US) -> DataFrame:
    """Episodes of a channel: ON is w > thr, close runs merge, short ones drop.

    An episode ends at its last ON row; a one-row run lasts 0 s.
    """
    thr = thr if isinstance(thr, Column) else F.lit(float(thr))
    runs = state_runs(df, keys, on_mark(F.col("w") > thr), hold_s=max_hold_s, max_gap_s=max_gap_s,
                      chunk_us=chunk_us).where("state = 1")
    return finish_episodes(runs, keys, min_dwell_s, merge_gap_s, chunk_us)


def finish_episodes(runs: DataFrame, keys: Sequence[str], min_dwell_s: float | Column,
                    merge_gap_s: float | Column, chunk_us: int = DAY_US) -> DataFrame:
    gap = merge_gap_s * S if isinstance(merge_gap_s, Column) else us(merge_gap_s)
    m = merge_intervals(runs, keys, "t_on_us", "t_off_us", gap, chunk_us=8 * chunk_us,
                        aggs={"energy_wh": ("sum", F.col("energy_wh")), "n_rows": ("sum", F.col("n_rows"))})
    dwell = min_dwell_s if isinstance(min_dwell_s, Column) else F.lit(float(min_dwell_s))
    return (m.withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6)
            .where(F.col("dur_s") >= dwell)
            .select(*keys, "t_on_us", "t_off_us", "dur_s", "energy_wh", "n_rows", "n_merged"))


def hysteresis_runs(df: DataFrame, keys: Sequence[str], hi: Column | float, lo: Column | float, *,
                    inclusive: bool = True, value: str = "w", chunk_us: int = DAY_US,
                    hold_s: float = 60.0, extra=None, aggs=None) -> DataFrame:
    """ON runs of a two-level detector. `inclusive` enters at >= hi and leaves at
    <= lo; otherwise strictly above and below. The state starts OFF."""
    v = F.col(value)
    mark = (F.when(v >= hi, 1).when(v <= lo, 0) if inclusive else F.when(v > hi, 1).when(v < lo, 0))
    return state_runs(df, keys, mark, chunk_us=chunk_us, hold_s=hold_s, extra=extra,
                      aggs=aggs).where("state = 1")


def anchor_episodes(df: DataFrame, keys: Sequence[str], thr: Column | float, *, min_dwell_s,
                    merge_gap_s, off_factor: float = 0.9, chunk_us: int = DAY_US,
                    hold_s: float = 60.0) -> DataFrame:
    """Threshold with hysteresis (OFF below off_factor x thr), merge, dwell."""
    thr = thr if isinstance(thr, Column) else F.lit(float(thr))
    runs = hysteresis_runs(df, keys, thr, thr * off_factor, inclusive=False, chunk_us=chunk_us,
                           hold_s=hold_s)
    return finish_episodes(runs, keys, min_dwell_s, merge_gap_s, chunk_us)


def numbered(df: DataFrame, keys: Sequence[str], chunk_us: int = DAY_US, out: str = "i") -> DataFrame:
    """Zero-based row index per key."""
    d = ordered_scan(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), row_number=out)
    return d.withColumn(out, F.col(out) - 1)


def detect_samples(df: DataFrame, keys: Sequence[str], hi, lo, *, min_samples: int = 2,
                   merge_samples: int = 0, value: str = "w", chunk_us: int = DAY_US) -> DataFrame:
    """Hysteresis detector in sample units: start index `i_on`, length `n_samples`.

    Runs shorter than `min_samples` drop first, then runs at most
    `merge_samples` apart merge.
    """
    runs = hysteresis_runs(numbered(df, keys, chunk_us), keys, hi, lo, value=value, chunk_us=chunk_us,
                           extra={"i": "i"})
    runs = (runs.where(F.col("n_rows") >= min_samples)
            .select(*keys, F.col("first.i").alias("i_on"), (F.col("last.i") + 1).alias("i_off"),
                    "t_on_us", "t_off_us", "energy_wh"))
    return merge_samples_runs(runs, keys, merge_samples)


def merge_samples_runs(runs: DataFrame, keys: Sequence[str], merge_samples: int) -> DataFrame:
    """Merge runs in index units (distance from end to next start)."""
    if merge_samples > 0:
        runs = islands(runs, keys, ["i_on"], bucket_of("i_on", 1 << 18),
                       row={"s": "i_on", "e": "i_off", "t0": "t_on_us", "t1": "t_off_us"},
                       breaks=lambda p, c: (c["s"] - p["e"]) > merge_samples,
                       aggs={"energy_wh": ("sum", F.col("energy_wh"))})
        runs = runs.select(*keys, F.col("first.s").alias("i_on"), F.col("last.e").alias("i_off"),
                           F.col("first.t0").alias("t_on_us"), F.col("last.t1").alias("t_off_us"), "energy_wh")
    return runs.withColumn("n_samples", F.col("i_off") - F.col("i_on"))


def gated_episodes(df: DataFrame, keys: Sequence[str], claim: Column, gated: Column, *,
                   merge_gap_s, min_dwell_s, gate_split_rows: int, chunk_us: int = DAY_US) -> DataFrame:
    """Claimed runs merged across short gaps unless the gap holds enough gated rows."""
    d = df.withColumn("_gate", gated.cast("int"))
    d = ordered_scan(d, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), running_sum={"_gc": "_gate"})
    runs = state_runs(d, keys, on_mark(claim), chunk_us=chunk_us,
                      extra={"gc": F.col("_gc"), "g": F.col("_gate")}).where("state = 1")
    m = merge_intervals(
        runs, keys, "t_on_us", "t_off_us", merge_gap_s * S if isinstance(merge_gap_s, Column) else us(merge_gap_s),
        chunk_us=8 * chunk_us, extra={"g0": F.col("first.gc") - F.col("first.g"), "g1": F.col("last.gc")},
        veto=lambda p, c: (c["g0"] - p["g1"]) >= gate_split_rows,
        aggs={"energy_wh": ("sum", F.col("energy_wh"))})
    dwell = min_dwell_s if isinstance(min_dwell_s, Column) else F.lit(float(min_dwell_s))
    return (m.withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6).where(F.col("dur_s") >= dwell))


def run_episodes(runs: DataFrame, keys: Sequence[str], *, merge_gap_s: float, min_dwell_s: float, gate_split_rows: int,
                 chunk_us: int = DAY_US) -> DataFrame:
    """`gated_episodes` of rows that come summed up to runs (ts_us, seq, last_us, claim, n_gated), which may go on in the next
    row of the same claim: keys, t_on_us, t_off_us, dur_s."""
    chunk = bucket_of("ts_us", chunk_us)
    d = ordered_scan(runs, keys, ["ts_us", "seq"], chunk, running_sum={"_gc": "n_gated"})
    r = islands(d, keys, ["ts_us", "seq"], chunk, row={"ts": "ts_us", "z": "last_us", "gc": "_gc", "g": "n_gated"}, mark=F.col("claim")).where("state = 1")
    r = r.select(*keys, F.col("first.ts").alias("t_on_us"), F.col("last.z").alias("t_off_us"), "first", "last")
    m = merge_intervals(r, keys, "t_on_us", "t_off_us", us(merge_gap_s), chunk_us=8 * chunk_us,
                        extra={"g0": F.col("first.gc") - F.col("first.g"), "g1": F.col("last.gc")}, veto=lambda p, c: (c["g0"] - p["g1"]) >= gate_split_rows)
    return m.withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6).where(F.col("dur_s") >= min_dwell_s)


def sample_episodes(df: DataFrame, keys: Sequence[str], on: Column, *, gap_samples: int = 2,
                    chunk_us: int = DAY_US) -> DataFrame:
    """ON runs bridged over at most `gap_samples` rows: i_on, i_off, n_samples."""
    runs = state_runs(numbered(df, keys, chunk_us), keys, on_mark(on), chunk_us=chunk_us,
                      extra={"i": "i"}).where("state = 1")
    runs = runs.select(*keys, F.col("first.i").alias("i_on"), (F.col("last.i") + 1).alias("i_off"),
                       "t_on_us", "t_off_us", "energy_wh")
    return merge_samples_runs(runs, keys, gap_samples)


def gaps(df: DataFrame, keys: Sequence[str], *, chunk_us: int = DAY_US, keep_last: bool = False,
         values: Sequence[str] = ()) -> DataFrame:
    """Each row with the next stamp of its key: next_us, dt_s and next_<value>."""
    g = ordered_scan(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us),
                     lead={"next_us": "ts_us", **{f"next_{v}": v for v in values}})
    g = g.withColumn("dt_s", (F.col("next_us") - F.col("ts_us")) / 1e6)
    return g if keep_last else g.where(F.col("next_us").isNotNull())


def with_previous(df: DataFrame, keys: Sequence[str], values: Sequence[str], *,
                  chunk_us: int = DAY_US) -> DataFrame:
    """Each row with the previous row's values as prev_<value> and dt_s."""
    d = ordered_scan(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us),
                     lag={"prev_us": "ts_us", **{f"prev_{v}": v for v in values}})
    return d.withColumn("dt_s", (F.col("ts_us") - F.col("prev_us")) / 1e6)


def sessions(df: DataFrame, keys: Sequence[str], tol_s: float, *, chunk_us: int = DAY_US) -> DataFrame:
    """Gap-free chunks: a new one starts where the gap exceeds `tol_s`."""
    r = islands(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), row={"ts": "ts_us"},
                breaks=lambda p, c: (c["ts"] - p["ts"]) > us(tol_s))
    return r.select(*keys, F.col("first.ts").alias("t0_us"), F.col("last.ts").alias("t1_us"), "n_rows")


def frozen_runs(df: DataFrame, keys: Sequence[str], min_s: Column | float, cadence_s: Column | float, *,
                chunk_us: int = DAY_US) -> DataFrame:
    """Runs of one unchanged value lasting count x cadence >= min_s."""
    r = islands(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), row={"ts": "ts_us", "w": "w"},
                breaks=lambda p, c: ~p["w"].eqNullSafe(c["w"]))
    cad = cadence_s if isinstance(cadence_s, Column) else F.lit(float(cadence_s))
    return (r.select(*keys, F.col("first.ts").alias("t0_us"), F.col("last.ts").alias("t1_us"),
                     F.col("first.w").alias("w"), "n_rows")
            .withColumn("len_s", F.col("n_rows") * cad).where(F.col("len_s") >= min_s))


def rolling(df: DataFrame, keys: Sequence[str], before: int, after: int, aggs: Mapping[str, Column], *,
            chunk_us: int = DAY_US, rows_per_chunk: int = 1 << 18) -> DataFrame:
    """Row-frame aggregates over [row - before, row + after]; frames are full
    inside the series, short at its ends. `aggs` are plain aggregate columns."""
    h = row_halo(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), before=before, after=after,
                 rows_per_chunk=rows_per_chunk)
    frame = halo_window(keys, ["_rn"]).rowsBetween(-before, after)
    return h.select("*", *[c.over(frame).alias(n) for n, c in aggs.items()]).where("_own").drop(
        "_chunk", "_own", "_len").withColumnRenamed("_rn", "i")


def step_signal(df: DataFrame, keys: Sequence[str], k: int, *, chunk_us: int = DAY_US,
                rows_per_chunk: int = 1 << 18) -> DataFrame:
    """mean(this and next k-1 rows) - mean(previous k rows), null without full frames."""
    h = row_halo(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), before=k + 1, after=k,
                 rows_per_chunk=rows_per_chunk)
    w = halo_window(keys, ["_rn"])
    fwd, bwd = w.rowsBetween(0, k - 1), w.rowsBetween(-k, -1)
    full = (F.count("w").over(fwd) == k) & (F.count("w").over(bwd) == k)
    h = h.withColumn("step", F.when(full, F.avg("w").over(fwd) - F.avg("w").over(bwd)))
    h = h.withColumn("prev_step", F.lag("step").over(w))
    return h.where("_own").drop("_chunk", "_own", "_len").withColumnRenamed("_rn", "i")


def rising_edges(df: DataFrame, value: Column, prev: Column, thr: Column | float) -> DataFrame:
    """Rows where the value is above `thr` and the previous one was not."""
    return df.where((value > thr) & ~F.coalesce(prev > thr, F.lit(False)))


def episodes_from_edges(rises: DataFrame, falls: DataFrame, keys: Sequence[str], min_dwell_s: float, *,
                        chunk_us: int = DAY_US) -> DataFrame:
    """Each rise with the next later fall (two rises may share one)."""
    e = next_after(rises.select(*keys, "ts_us"), falls.select(*keys, "ts_us"), keys, [], strict=True,
                   chunk_us=chunk_us).where(F.col("n_ts_us").isNotNull())
    return (e.select(*keys, F.col("ts_us").alias("t_on_us"), F.col("n_ts_us").alias("t_off_us"))
            .withColumn("dur_s", (F.col("t_off_us") - F.col("t_on_us")) / 1e6)
            .where(F.col("dur_s") >= min_dwell_s))


def activation_runs(df: DataFrame, keys: Sequence[str], *, on_w: float, off_w: float, base_s: float = 60.0,
                    chunk_us: int = DAY_US, rows_per_chunk: int = 1 << 18) -> DataFrame:
    """Runs on the 5-row centred mean (3 rows at least): start at each rise over
    `on_w`, end at the first of three rows under `off_w` (near the series end one
    suffices). Output t0_us, t1_us (the row after that first), dp_w, dur_s; dp_w
    is the smoothed peak less the median of the `base_s` before the start.
    """
    h = row_halo(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), before=3, after=4,
                 rows_per_chunk=rows_per_chunk)
    win = halo_window(keys, ["_rn"])
    f5 = win.rowsBetween(-2, 2)
    h = h.withColumn("sm", F.when(F.count("w").over(f5) >= 3, F.avg("w").over(f5)))
    above, below = F.col("sm") > on_w, F.coalesce(F.col("sm") < off_w, F.lit(False))
    h = h.select("*", F.coalesce(above, F.lit(False)).alias("_ab"), below.alias("_be"))
    h = h.select("*", F.lag("_ab").over(win).alias("_pab"),
                 (F.coalesce(F.lead("_be", 1).over(win), F.lit(False))
                  & F.coalesce(F.lead("_be", 2).over(win), F.lit(False))).alias("_two"),
                 F.coalesce(F.lead("ts_us").over(win), F.col("ts_us")).alias("_after")).where("_own")
    h = h.withColumn("_end", F.col("_be") & (F.col("_two") | (F.col("_rn") >= F.col("_len") - 3)))
    h = h.withColumn("_start", F.col("_ab") & (F.col("_pab") == F.lit(False)))
    level = h.select(*keys, "ts_us", "sm")
    keys, numbers = list(keys), bucket_of("_rn", rows_per_chunk)
    # rows up to an end form a stretch; every start in it shares that end, so a run's peak is a running maximum back from the end
    h = h.select(*keys, "ts_us", "_rn", "sm", "_start", F.col("_end").cast("int").alias("_e"), F.when(F.col("_end"), F.col("_after")).alias("_stop"))
    h = ordered_scan(h, keys, ["_rn"], numbers, bfill={"_t1": "_stop"}, running_sum={"_ends": "_e"})
    h = h.withColumn("_stretch", F.col("_ends") - F.col("_e")).withColumn("_back", -F.col("_rn")).where("_t1 IS NOT NULL")
    h = ordered_scan(h, [*keys, "_stretch"], ["_back"], bucket_of("_back", rows_per_chunk), running_max={"_high": "sm"})
    runs = h.where("_start").groupBy(*keys, F.col("ts_us").alias("t0_us"), F.col("_t1").alias("t1_us")).agg(F.max("_high").alias("_high"))
    # the row after the end, and other rows at the first and last stamp, count too
    stamps = level.groupBy(*keys, F.col("ts_us").alias("_t")).agg(F.max("sm").alias("_sm"))
    at = lambda c, o: stamps.select(*keys, F.col("_t").alias(c), F.col("_sm").alias(o))
    runs = runs.join(at("t0_us", "_sm0"), [*keys, "t0_us"]).join(at("t1_us", "_sm1"), [*keys, "t1_us"])
    base = frame_stats(runs, df, keys, "t0_us", {"_base": ("median", "w", -us(base_s), 0)})
    return (runs.join(base, [*keys, "t0_us"], "left")
            .select(*keys, "t0_us", "t1_us", (F.greatest("_high", "_sm0", "_sm1") - F.col("_base")).alias("dp_w"),
                    ((F.col("t1_us") - F.col("t0_us")) / 1e6).alias("dur_s")))


def release_runs(df: DataFrame, keys: Sequence[str], *, on_w: float, off_w: float, value: str = "w",
                 chunk_us: int = DAY_US, rows_per_chunk: int = 1 << 18) -> DataFrame:
    """Disjoint runs: enter at >= on_w, release after three rows below off_w, end at
    the last row that was not below (the last row of the series when still open)."""
    h = row_halo(df, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), before=2, after=0,
                 rows_per_chunk=rows_per_chunk)
    win = halo_window(keys, ["_rn"])
    lo = F.col(value) < off_w
    p = [F.coalesce(F.lag(value, k).over(win) < off_w, F.lit(False)) for k in (1, 2)]
    h = h.select("*", (lo & p[0] & p[1]).alias("_rel"), F.lag("ts_us", 2).over(win).alias("_ts2")).where("_own")
    mark = F.when(F.col(value) >= on_w, 1).when(F.col("_rel"), 0)
    r = islands(h, keys, ["_rn"], bucket_of("_rn", rows_per_chunk), mark=mark,
                row={"ts": "ts_us", "ts2": "_ts2", "rn": "_rn"}, aggs={"peak": ("max", F.col(value))})
    end = F.when(F.col("next").isNull(), F.col("last.ts")).otherwise(F.col("last.ts2"))
    n = F.when(F.col("next").isNull(), F.col("last.rn")).otherwise(F.col("last.rn") - 2) - F.col("first.rn")
    return (r.where("state = 1").select(*keys, F.col("first.ts").alias("t0_us"), end.alias("t1_us"),
                                        "peak", n.alias("n_steps")))


def chain_runs(runs: DataFrame, keys: Sequence[str], gap_us: int | Column, *, start="t0_us", end="t1_us",
               chunk_us: int = 32 * DAY_US) -> DataFrame:
    """Link runs whose distance to the running end is at most `gap_us`."""
    return merge_intervals(runs, keys, start, end, gap_us, overlapping=True, chunk_us=chunk_us)


def anchored_windows(runs: DataFrame, keys: Sequence[str], dur_s: Column | float, *, pre_frac: float = 0.25,
                     merge_frac: float = 0.5, chunk_us: int = 32 * DAY_US) -> DataFrame:
    """Window of length dur around each run start, merged when they overlap by
    at least merge_frac x dur; the first anchor's start names the window."""
    dur_us = (as_col(dur_s) if isinstance(dur_s, (str, Column)) else F.lit(float(dur_s))) * S
    w = runs.withColumn("c0_us", (F.col("t0_us") - F.floor(dur_us * pre_frac)).cast("bigint"))
    w = w.withColumn("c1_us", (F.col("c0_us") + F.floor(dur_us)).cast("bigint"))
    return merge_intervals(w, keys, "c0_us", "c1_us", -F.floor(dur_us * merge_frac).cast("bigint"),
                           overlapping=True, chunk_us=chunk_us,
                           aggs={"anchor_us": ("first", F.col("t0_us"))})


def dense_start(df: DataFrame, keys: Sequence[str], need_rows: int, span_s: float, *,
                leading: bool = False, chunk_us: int = DAY_US) -> DataFrame:
    """First stamp whose trailing `span_s` (or leading, by option) holds `need_rows` rows.

    The count is a difference of row numbers: the far end of each window is
    looked up once, so the cost does not grow with the rows per window.
    """
    span = us(span_s)
    n = numbered(df, keys, chunk_us).select(*keys, "ts_us", "i")
    far = n.select(*keys, F.col("ts_us").alias("t0"), F.col("i").alias("i0"), (F.col("ts_us") + (span if leading else -span)).alias("ts_us"))
    if leading:
        c = last_before(far, n, keys, ["i"], chunk_us=chunk_us, prefix="f_").withColumn("_n", F.col("f_i") - F.col("i0") + 1)
    else:
        c = next_after(far, n, keys, ["i"], chunk_us=chunk_us, prefix="f_").withColumn("_n", F.col("i0") - F.col("f_i") + 1)
    return c.where(F.col("_n") >= need_rows).groupBy(*keys).agg(F.min("t0").alias("dense_us"))


def best_window(df: DataFrame, keys: Sequence[str], span_s: float, value: Column, *,
                max_share: float | None = None, on: Column | None = None, chunk_us: int = DAY_US) -> DataFrame:
    """Start of the highest-sum window [t, t + span) among row starts, earliest on ties.

    `max_share` skips windows whose ON share exceeds it. Sums are differences of
    running totals.
    """
    keys = list(keys)
    d = df.select(*keys, "ts_us", "seq", F.coalesce(value, F.lit(0.0)).alias("_v"), (on if on is not None else F.lit(False)).cast("int").alias("_on"))
    d = ordered_scan(d, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), running_sum={"_cv": "_v", "_co": "_on"}, row_number="_i")
    start = d.select(*keys, F.col("ts_us").alias("t0"), (F.col("_cv") - F.col("_v")).alias("_v0"), (F.col("_co") - F.col("_on")).alias("_o0"), (F.col("_i") - 1).alias("_i0"),
                     (F.col("ts_us") + us(span_s) - 1).alias("ts_us"))
    e = last_before(start, d, keys, ["_cv", "_co", "_i"], chunk_us=chunk_us, prefix="e")
    n = F.col("e_i") - F.col("_i0")
    h = e.select(*keys, F.col("t0").alias("ts_us"), (F.col("e_cv") - F.col("_v0")).alias("sum_w"), ((F.col("e_co") - F.col("_o0")) / n).alias("on_share"), n.alias("n_rows"))
    if max_share is not None:
        h = h.where(F.col("on_share") <= max_share)
    best = F.max_by(F.struct("ts_us", "sum_w", "on_share", "n_rows"), F.struct(F.col("sum_w"), -F.col("ts_us")))
    return h.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
