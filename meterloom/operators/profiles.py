"""Calibration profiles, presses, session parameters and interference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .episodes import us
from .frames import frame_stats
from .joins import last_before, next_after, overlap_count, overlap_join, points_in
from .ordered import DAY_US, join_dim
from .quantiles import exact_quantiles

# fixed values of the session-supervised decoder
SIGMA_FLOOR_W = 5.0
MU_MIN_W = 5.0
DWELL_CLAMP_S = (30.0, 86400.0)
MAX_COVER = 0.20
K_GRID = (1, 2, 3, 5, 10, 20)
N_DRAWS = 20
SPAN = ("t_on_us", "t_off_us")


def cover_share(sessions: DataFrame, others: DataFrame, keys: Sequence[str], max_cover: float = MAX_COVER, *,
                device: str = "device", bucket_us: int = DAY_US) -> DataFrame:
    """Share of a session covered by other devices' episodes (summed) and its flag."""
    keys = list(keys)
    sid = [*keys, device, "t_on_us", "t_off_us"]
    base = sessions.select(*sid).distinct()
    p = overlap_join(base, others.select(*sid), keys, left_span=SPAN, right_span=SPAN, bucket_us=bucket_us,
                     extra=F.col(f"l.{device}") != F.col(f"r.{device}"))
    ov = F.least("l.t_off_us", "r.t_off_us") - F.greatest("l.t_on_us", "r.t_on_us")
    c = (p.select(*keys, *[F.col(f"l.{x}").alias(x) for x in (device, "t_on_us", "t_off_us")], ov.alias("_ov"))
         .groupBy(*sid).agg(F.sum("_ov").alias("_c")))
    out = base.join(c, sid, "left")
    share = F.coalesce("_c", F.lit(0)) / F.greatest(F.col("t_off_us") - F.col("t_on_us"), F.lit(1))
    return out.select(*sid, share.alias("cover"), (share > max_cover).alias("flagged"))


def tag_cooccurring(ep: DataFrame, keys: Sequence[str], *, device: str = "device", bucket_us: int = DAY_US) -> DataFrame:
    """`co` is true when the episode overlaps one of another device."""
    out = overlap_count(ep, ep, keys, left_span=SPAN, right_span=SPAN, left_id=[device, "t_on_us"], out="_n", other=device, chunk_us=bucket_us)
    return out.select(*ep.columns, (F.col("_n") > 0).alias("co"))


def onset_interference(ep: DataFrame, keys: Sequence[str], pad_s: float, *, device: str = "device",
                       bucket_us: int = DAY_US) -> DataFrame:
    """`interfered`: another device's episode is open within `pad_s` of the onset."""
    pad = us(pad_s)
    a = ep.withColumn("_a", F.col("t_on_us") - pad).withColumn("_z", F.col("t_on_us") + pad)
    out = overlap_count(a, ep, keys, left_span=("_a", "_z"), right_span=SPAN, left_id=[device, "t_on_us"], out="_n", other=device, touch=True, chunk_us=bucket_us)
    return out.select(*ep.columns, (F.col("_n") > 0).alias("interfered"))


def readings_in(readings: DataFrame, ep: DataFrame, keys: Sequence[str], ids: Sequence[str], *,
                bucket_us: int = DAY_US, salts: int = 1) -> DataFrame:
    """Peak, mean, deviation, median and count of the readings inside each episode."""
    keys, ids = list(keys), list(ids)
    j = points_in(readings.select(*keys, "ts_us", "w"), ep.select(*dict.fromkeys([*keys, *ids, *SPAN])), keys,
                  start="t_on_us", end="t_off_us", bucket_us=bucket_us, salts=salts)
    g = j.groupBy(*keys, *ids).agg(F.max("w").alias("peak"), F.avg("w").alias("mean_w"), F.stddev_pop("w").alias("sd_w"),
                                   F.count("w").alias("n"))
    return g.join(exact_quantiles(j, [*keys, *ids], {"med_w": ("w", 0.5)}), [*keys, *ids])


def pairwise_additivity(ep: DataFrame, mains: DataFrame, level: DataFrame, keys: Sequence[str], *, min_overlap_s: float,
                        min_rows: int, bucket_us: int = DAY_US) -> DataFrame:
    """Mains level while two devices overlap against the sum of their levels."""
    keys = list(keys)
    p = overlap_join(ep, ep, keys, left_span=SPAN, right_span=SPAN, bucket_us=bucket_us, extra=F.col("l.device") < F.col("r.device"))
    p = p.select(*keys, F.col("l.device").alias("a"), F.col("r.device").alias("b"), F.greatest("l.t_on_us", "r.t_on_us").alias("t_on_us"),
                 F.least("l.t_off_us", "r.t_off_us").alias("t_off_us")).where(F.col("t_off_us") - F.col("t_on_us") >= us(min_overlap_s))
    o = (points_in(mains.select(*keys, "ts_us", "w"), p, keys, start="t_on_us", end="t_off_us", bucket_us=bucket_us)
         .groupBy(*keys, "a", "b", *SPAN).agg(F.avg("w").alias("obs"), F.count("w").alias("_n")).where(F.col("_n") >= min_rows))
    la = level.select(F.col("device").alias("a"), F.col("mu_w").alias("_ma"))
    lb = level.select(F.col("device").alias("b"), F.col("mu_w").alias("_mb"))
    o = join_dim(join_dim(o, la, ["a"]), lb, ["b"]).withColumn("pred_sum", F.col("_ma") + F.col("_mb")).withColumn("ratio", F.col("obs") / F.col("pred_sum"))
    return exact_quantiles(o, ["a", "b", "pred_sum"], {"obs_p50": ("obs", 0.5), "ratio_p50": ("ratio", 0.5)}, {"n_overlaps": "obs"})


def align_presses(presses: DataFrame, ep: DataFrame, keys: Sequence[str], *, window_s: float, chunk_us: int = DAY_US) -> DataFrame:
    """Each press: inside an open episode (latency 0), before the next onset
    within the window, or uncovered."""
    keys = list(keys)
    p = presses.select(*keys, "press_us", F.col("press_us").alias("ts_us"))
    on = ep.select(*keys, F.col("t_on_us").alias("ts_us"), "t_off_us")
    # strictly earlier onset: shift the onset by one so that an equal stamp does not count
    prev = last_before(p, on.withColumn("ts_us", F.col("ts_us") + 1), keys, ["t_off_us"], chunk_us=chunk_us, prefix="p_")
    both = next_after(prev, on, keys, [], chunk_us=chunk_us, prefix="n_")
    open_ = F.coalesce(F.col("p_t_off_us") > F.col("press_us"), F.lit(False))
    nxt = F.coalesce(F.col("n_ts_us") - F.col("press_us") <= us(window_s), F.lit(False))
    return both.select(*keys, "press_us", F.when(open_, "already_on").when(nxt, "new_activation").otherwise("uncovered").alias("mode"),
                       F.when(open_, 0.0).when(nxt, (F.col("n_ts_us") - F.col("press_us")) / 1e6).alias("lat_s"))


def missed_activations(presses: DataFrame, ep: DataFrame, keys: Sequence[str], *, window_s: float, grace_s: float,
                       bucket_us: int = DAY_US) -> DataFrame:
    """Episodes without a press in [onset - window, onset + grace]."""
    keys = list(keys)
    e = ep.select(*keys, "t_on_us").withColumn("_a", F.col("t_on_us") - us(window_s)).withColumn("_z", F.col("t_on_us") + us(grace_s))
    p = presses.select(*keys, F.col("press_us").alias("ts_us"))
    hit = points_in(p, e, keys, start="_a", end="_z", bucket_us=bucket_us).select(*keys, "t_on_us").distinct().withColumn("_h", F.lit(True))
    return e.join(hit, [*keys, "t_on_us"], "left").select(*keys, "t_on_us", F.col("_h").isNull().alias("missed"))


def press_classes(aligned: DataFrame, missed: DataFrame, keys: Sequence[str], *, min_presses: int) -> DataFrame:
    """Coverage, latency percentiles and class of each press channel."""
    keys = list(keys)
    a = aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("presses"), F.avg((F.col("mode") != "uncovered").cast("int")).alias("cover"))
    q = exact_quantiles(aligned.withColumn("_l", F.when(F.col("lat_s") > 0, F.col("lat_s"))), keys, {"lat_p50": ("_l", 0.5), "lat_p90": ("_l", 0.9)})
    m = missed.groupBy(*keys).agg(F.count(F.lit(1)).alias("acts"), F.avg(F.col("missed").cast("int")).alias("miss_frac"))
    j = a.join(q, keys, "left").join(m, keys, "left")
    cls = (F.when(F.col("presses") < min_presses, "sparse").when(F.coalesce("acts", F.lit(0)) == 0, "invisible")
           .when(F.col("cover") >= 0.5, "aligned").when(F.col("cover") >= 0.1, "partial").otherwise("decoupled"))
    return j.withColumn("class", cls)


def cycle_features(cycles: DataFrame, runs: DataFrame, keys: Sequence[str], ids: Sequence[str], *, lead_s: float = 60.0,
                   bucket_us: int = DAY_US) -> DataFrame:
    """Strongest activation inside a cycle and the largest gap between run starts."""
    keys, ids = list(keys), list(ids)
    c = cycles.withColumn("_a", F.col("t_on_us") - us(lead_s))
    j = points_in(runs.select(*keys, F.col("t0_us").alias("ts_us"), "dp_w"), c.select(*dict.fromkeys([*keys, *ids, "_a", "t_off_us"])), keys, start="_a",
                  end="t_off_us", bucket_us=bucket_us)
    g = j.withColumn("_g", (F.col("ts_us") - F.lag("ts_us").over(W.partitionBy(*keys, *ids).orderBy("ts_us"))) / 1e6)
    f = g.groupBy(*keys, *ids).agg(F.max("dp_w").alias("dp_peak"), F.max("_g").alias("gap_max_s"), F.count(F.lit(1)).alias("n_runs"))
    return cycles.join(f, [*keys, *ids], "left").withColumn("gap_max_s", F.coalesce("gap_max_s", F.lit(0.0))).fillna(0, ["n_runs"])


def spike_and_settle(anchors: DataFrame, steps: DataFrame, keys: Sequence[str], *, spike_s: float, near_s: float, far_s: float,
                     max_dt_s: float, bucket_us: int = DAY_US // 4) -> DataFrame:
    """Largest step within `spike_s` of an anchor; median after minus median before."""
    d = steps.select(*keys, "ts_us", "w", F.when(F.col("dt_s") <= max_dt_s, F.col("st")).alias("_st"))
    spike, near, far = us(spike_s), us(near_s), us(far_s)
    got = frame_stats(anchors, d, keys, "anchor_us", {"spike": ("max", "_st", 1 - spike, spike + 1), "_pre": ("median", "w", -far, -near),
                                                      "_post": ("median", "w", near + 1, far + 1)}, chunk_us=bucket_us)
    return got.select(*keys, "anchor_us", "spike", (F.col("_post") - F.col("_pre")).alias("settle"))
