"""Parameters from sessions, signatures, classification and identification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .episodes import numbered, on_mark, state_runs, us
from .frames import frame_stats
from .joins import points_in
from .ordered import DAY_US, bucket_of, join_dim, ordered_scan
from .profiles import DWELL_CLAMP_S, MU_MIN_W, SIGMA_FLOOR_W, onset_interference
from .quantiles import exact_quantiles
from .sampling import draw
from .stats import on_level

CAL_DAYS = 7.0
MIN_SAMPLES = 2


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def first_days(df: DataFrame, keys: Sequence[str], days: float) -> DataFrame:
    """Adds `cal`: the row lies in the first `days` of its key's span."""
    t0 = df.groupBy(*keys).agg(F.min("ts_us").alias("_t0"))
    return join_dim(df, t0, keys).withColumn("cal", F.col("ts_us") < F.col("_t0") + int(days * DAY_US)).drop("_t0")


def signatures(df: DataFrame, keys: Sequence[str], *, dt_s: float, min_samples: int = MIN_SAMPLES, chunk_us: int = DAY_US) -> DataFrame:
    """ON level percentiles, dwell percentiles, episode count and energy of the
    given (calibration) rows."""
    keys = list(keys)
    d = on_level(df, keys)
    lv = exact_quantiles(d.withColumn("_on", F.when(F.col("on"), F.col("w"))), keys,
                         {"on_w": ("_on", 0.5), "on_p10_w": ("_on", 0.1), "on_p25_w": ("_on", 0.25), "on_p90_w": ("_on", 0.9)})
    runs = state_runs(d, keys, on_mark(F.col("on")), chunk_us=chunk_us).where(f"state = 1 and n_rows >= {min_samples}")
    dw = exact_quantiles(runs.withColumn("_s", F.col("n_rows") * dt_s), keys,
                         {"dwell_p10_s": ("_s", 0.1), "dwell_p50_s": ("_s", 0.5), "dwell_p90_s": ("_s", 0.9)}, {"n_cal_eps": "_s"})
    e = df.groupBy(*keys).agg((F.sum("w") * dt_s / 3.6e6).alias("cal_energy_kwh"))
    names = ["on_w", "on_p10_w", "on_p25_w", "on_p90_w", "dwell_p10_s", "dwell_p50_s", "dwell_p90_s", "n_cal_eps"]
    return e.join(lv, keys, "left").join(dw, keys, "left").fillna(0, names)


def press_profiles(ep: DataFrame, mains: DataFrame, keys: Sequence[str], *, device: str = "device", base_s: float = 60.0, step_s: float = 30.0,
                   pad_s: float = 60.0, bucket_us: int = DAY_US) -> DataFrame:
    """Per session: median mains before and after a press at the onset, their
    difference and the interference flag."""
    keys = list(keys)
    e = onset_interference(ep, keys, pad_s, device=device, bucket_us=bucket_us)
    a = e.select(*keys, device, "t_on_us", (F.col("t_on_us") - us(base_s)).alias("_a"), (F.col("t_on_us") + us(step_s)).alias("_z"))
    j = points_in(mains.select(*keys, "ts_us", "w"), a, keys, start="_a", end="_z", closed="left", bucket_us=bucket_us)
    pre = F.col("ts_us") < F.col("t_on_us")
    # base_s + step_s bound the rows of one press
    lv = j.groupBy(*keys, device, "t_on_us").agg(F.percentile(F.when(pre, F.col("w")), 0.5).alias("base_w"), F.percentile(F.when(~pre, F.col("w")), 0.5).alias("post_w"))
    return e.join(lv, [*keys, device, "t_on_us"], "left").withColumn("dp_w", F.col("post_w") - F.col("base_w"))


def class_profiles(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median step and dwell over clean sessions of each class."""
    by = list(by)
    ok = ~F.col("interfered") & F.col("dp_w").isNotNull()
    n = sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("interfered").alias("flagged"))
    return n.join(exact_quantiles(sessions.where(ok), by, {"dp_w": ("dp_w", 0.5), "dwell_s": ("dur_s", 0.5)}), by, "left")


def pre_press_level(presses: DataFrame, mains: DataFrame, keys: Sequence[str], *, span_s: float = 120.0, gap_s: float = 10.0, fallback: float = 0.0,
                    bucket_us: int = DAY_US) -> DataFrame:
    """Median mains in [press - span, press - gap); `fallback` under three rows."""
    keys = list(keys)
    g = frame_stats(presses, mains, keys, "press_us", {"_m": ("median", "w", -us(span_s), -us(gap_s)), "_n": ("count", "w", -us(span_s), -us(gap_s))}, chunk_us=bucket_us)
    return presses.join(g, [*keys, "press_us"], "left").withColumn(
        "level_w", F.when(F.coalesce("_n", F.lit(0)) >= 3, F.col("_m")).otherwise(fallback)).drop("_m", "_n")


def session_levels(sessions: DataFrame, mains: DataFrame, keys: Sequence[str], ids: Sequence[str], *, shave_s: float = 10.0,
                   bucket_us: int = DAY_US) -> DataFrame:
    """Mean and population deviation of the mains inside each shaved session (two rows at least)."""
    keys, ids = list(keys), list(ids)
    s = sessions.select(*dict.fromkeys([*keys, *ids, "t_on_us", "t_off_us"])).distinct()
    s = s.withColumn("_a", F.col("t_on_us") + us(shave_s)).withColumn("_z", F.greatest(F.col("t_off_us") - us(shave_s), F.col("_a")))
    g = (points_in(mains.select(*keys, "ts_us", "w"), s.select(*dict.fromkeys([*keys, *ids, "t_on_us", "t_off_us", "_a", "_z"])), keys, start="_a", end="_z", bucket_us=bucket_us)
         .groupBy(*dict.fromkeys([*keys, *ids, "t_on_us", "t_off_us"])).agg(F.avg("w").alias("level_w"), F.stddev_pop("w").alias("sess_sd_w"), F.count("w").alias("_n")))
    return g.where("_n >= 2").drop("_n")


def params_from_sessions(levels: DataFrame, floor: DataFrame, keys: Sequence[str], by: Sequence[str], cadence_s: float, *, min_level_w: float = MU_MIN_W) -> DataFrame:
    """mu, sd, dwell and stay probability per `by`; groups whose level does not
    clear the floor are dropped (not separable)."""
    d = join_dim(levels, floor.select(*keys, "floor_w"), keys)
    g = d.groupBy(*by).agg(F.avg(F.col("level_w") - F.col("floor_w")).alias("mu_w"), F.avg("sess_sd_w").alias("_sd"),
                           F.avg((F.col("t_off_us") - F.col("t_on_us")) / 1e6).alias("_dur"))
    dwell = clamp(F.col("_dur"), *DWELL_CLAMP_S)
    return g.where(F.col("mu_w") >= min_level_w).select(*by, "mu_w", F.greatest("_sd", F.lit(SIGMA_FLOOR_W)).alias("sd_w"), dwell.alias("dwell_s"),
                                                        (1.0 - 1.0 / F.greatest(dwell / cadence_s, F.lit(1.0))).alias("p_stay"))


def draw_sessions(pool: DataFrame, by: Sequence[str], flagged: str, ks: Sequence[int], n_draws: int, seed: int) -> DataFrame:
    """Draws with replacement until k unflagged sessions, at most max(4k, 8) tries.

    The pick of (k, draw, slot) is a hash, so every worker agrees on it. A pool
    is numbered once and the slots meet it by index. Adds k, draw, slot (tries
    count from 0, in rounds of k as one draw takes k sessions at a time).
    """
    by = list(by)
    n = ordered_scan(pool, by, ["t_on_us"], bucket_of("t_on_us", 32 * DAY_US), row_number="_i", total={"_size": F.lit(1)})
    size = n.groupBy(*by).agg(F.max("_size").alias("_size"))
    plan = [(k, ((max(4 * k, 8) + k - 1) // k) * k) for k in ks]
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in plan]))
    slots = (size.select(*by, "_size", tries.alias("p")).select(*by, "_size", "p.*")
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("m") - 1))))
    slots = slots.withColumn("_i", draw(F.col("_size"), seed, "k", "draw", "slot", *by) + 1)
    d = slots.join(n.drop("_size"), [*by, "_i"])
    # at most max(4k, 8) + k rows per (k, draw)
    w = W.partitionBy(*by, "k", "draw").orderBy("slot")
    good = F.sum((~F.col(flagged)).cast("int")).over(w)
    return d.select("*", good.alias("_good")).where(~F.col(flagged) & (F.col("_good") <= F.col("k"))).drop("_i", "_size", "m", "_good")


def separability(mu: Column, floor: Column, sigma: Column) -> list[Column]:
    margin = (mu - floor) / sigma
    return [margin.alias("margin"), F.when(margin >= 4, "clear").when(margin >= 2, "marginal").otherwise("sub-noise").alias("verdict")]


def classify_events(events: DataFrame, library: DataFrame, keys: Sequence[str], ids: Sequence[str], *, margin: float = 0.0, plausible: bool = False,
                    dwell_prior: bool = False) -> DataFrame:
    """Nearest signature in (relative level, log dwell) with optional rejections.

    `events`: keys, ids, level_w, dwell_s. `library`: keys, device, on_w,
    dwell_p10_s, dwell_p50_s, dwell_p90_s. Adds device, dist, reject.
    """
    keys, ids = list(keys), list(ids)
    lib = library.select(*keys, "device", "on_w", F.greatest("dwell_p50_s", F.lit(30.0)).alias("_d50"), F.greatest("dwell_p10_s", F.lit(10.0)).alias("_d10"),
                         F.greatest("dwell_p90_s", F.lit(30.0)).alias("_d90"))
    # the signatures of a house become one array, so each event meets them in its own row
    lib = lib.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("device", "on_w", "_d50", "_d10", "_d90"))).alias("_lib"))
    e = join_dim(events, lib, keys)
    dist = lambda x: (F.abs(F.col("level_w") - x["on_w"]) / F.greatest(x["on_w"], F.lit(1.0))
                      + 0.5 * F.abs(F.ln(F.col("dwell_s") + 1) - F.ln(x["_d50"] + 1)) / F.ln(F.lit(2.0)))
    ranked = F.array_sort(F.transform("_lib", lambda x: F.struct(dist(x).alias("d"), x.alias("s"))))
    e = e.withColumn("_r", ranked)
    b = F.get("_r", F.lit(0))
    second = F.coalesce(F.get("_r", F.lit(1))["d"], b["d"])
    rej = F.lit(None).cast("string")
    if dwell_prior:
        rej = F.when(~((F.col("dwell_s") >= 0.5 * b["s"]["_d10"]) & (F.col("dwell_s") <= 2.0 * b["s"]["_d90"])), "dwell").otherwise(rej)
    if plausible:
        rej = F.when(b["s"]["on_w"] < 0.6 * F.col("level_w"), "plausibility").otherwise(rej)
    if margin:
        rej = F.when(second / F.greatest(b["d"], F.lit(1e-9)) < margin, "margin").otherwise(rej)
    return e.select(*[c for c in events.columns], b["s"]["device"].alias("device"), b["d"].alias("dist"), rej.alias("reject"))


def step_classes(df: DataFrame, profiles: DataFrame, keys: Sequence[str], *, min_step_w: float = 45.0, within: float = 0.45) -> DataFrame:
    """|step| over `min_step_w` goes to the nearest profile level if within 45 % of it."""
    keys = list(keys)
    lib = profiles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("device", "level_w"))).alias("_lib"))  # devices of a house
    d = join_dim(df.where(F.abs("step_w") > min_step_w), lib, keys)
    best = F.get(F.array_sort(F.transform("_lib", lambda x: F.struct(F.abs(F.abs(F.col("step_w")) - x["level_w"]).alias("d"), x["device"].alias("device"), x["level_w"].alias("l")))), F.lit(0))
    return d.select(*df.columns, F.when(best["d"] < within * best["l"], best["device"]).alias("device"))


def nearest_other(marks: DataFrame, label: str, mark_id: str, features: Sequence[str], *, per_label: int, seed: int = 0) -> DataFrame:
    """Nearest other mark of every mark by summed absolute log ratios.

    The library is the operator's own fixed-size subsample (`per_label` marks of
    each label by hash order), so the pairing stays linear in the marks; all
    marks are classified against it.
    """
    m = marks.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(mark_id).cast("string"))))
    # the first of each hash bucket, then the first of all: no label is ranked as a whole
    pre = m.withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(64)))
    few = pre.select("*", F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", mark_id)).alias("_rp")).where(F.col("_rp") <= per_label)
    few = few.select("*", F.row_number().over(W.partitionBy(label).orderBy("_h", mark_id)).alias("_rk")).where(F.col("_rk") <= per_label)
    lib = few.agg(F.collect_list(F.struct(F.col(mark_id).alias("oid"), F.col(label).alias("pred"), *features)).alias("_lib"))  # per_label marks a label
    dist = lambda x: sum((F.abs(F.ln(x[f] / F.greatest(F.col(f), F.lit(1.0)))) for f in features), F.lit(0.0))
    best = F.array_min(F.transform(F.filter("_lib", lambda x: x["oid"] != F.col(mark_id)), lambda x: F.struct(dist(x).alias("dist"), x["oid"].alias("oid"), x["pred"].alias("pred"))))
    return marks.select(label, mark_id, *features).crossJoin(F.broadcast(lib)).select(label, mark_id, best.alias("b")).select(label, mark_id, F.col("b.pred").alias("pred"), F.col("b.dist").alias("dist"))
