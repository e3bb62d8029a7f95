"""Channel statistics: cadence, thresholds, floors, batteries, shift scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .energy import hold_energy
from .episodes import gaps, numbered, sample_episodes, with_previous
from .ordered import DAY_US, as_col, bucket_of, join_dim, ordered_scan
from .quantiles import exact_quantiles, with_quantiles

NOISE_FLOOR_W = 5.0  # fixed value: watts below which a channel is idle
MIN_ABOVE = 100      # fixed value: samples needed before the half-median rule applies


def round_even(c: Column | str, digits: int) -> Column:
    """Half-even in binary arithmetic, as SQL's round_even on doubles. `bround` rounds the shortest decimal form
    instead: a half with noise in its last bit, such as the mean of two readings, went to the other side."""
    return F.rint(as_col(c) * 10.0**digits) / 10.0**digits


def cadence(df: DataFrame, keys: Sequence[str], *, chunk_us: int = DAY_US) -> DataFrame:
    """Median and p90 of the positive gaps in seconds, and their number."""
    g = gaps(df, keys, chunk_us=chunk_us).where("dt_s > 0")
    return exact_quantiles(g, keys, {"dt_med_s": ("dt_s", 0.5), "dt_p90_s": ("dt_s", 0.9)}, {"n_gaps": "dt_s"})


def modal_gap(df: DataFrame, keys: Sequence[str], *, under_s: float = 60.0, digits: int = 1,
              chunk_us: int = DAY_US) -> DataFrame:
    """Most frequent rounded gap below `under_s`; the smaller wins a tie."""
    g = gaps(df, keys, chunk_us=chunk_us).where(f"dt_s > 0 and dt_s < {under_s}")
    c = g.groupBy(*keys, F.bround("dt_s", digits).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*keys).agg(F.max_by("_d", F.struct("_c", -F.col("_d"))).alias("modal_dt_s"))


def fill_share(df: DataFrame, keys: Sequence[str], *, chunk_us: int = DAY_US) -> DataFrame:
    """Rows present over rows expected at the median gap."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span_s"))
    return (n.join(cadence(df, keys, chunk_us=chunk_us), list(keys), "left")
            .withColumn("fill", F.col("n") / (F.col("span_s") / F.col("dt_med_s") + 1)))


def gap_fraction(df: DataFrame, keys: Sequence[str], k: float = 3.0, *, least_s: float = 0.0,
                 chunk_us: int = DAY_US) -> DataFrame:
    """Share of gaps longer than k times the median gap (and than `least_s`)."""
    g = with_quantiles(gaps(df, keys, chunk_us=chunk_us), keys, {"_m": (F.when(F.col("dt_s") > 0, F.col("dt_s")), 0.5)})
    limit = F.greatest(F.lit(float(least_s)), k * F.col("_m"))
    return g.groupBy(*keys).agg(F.avg((F.col("dt_s") > limit).cast("int")).alias("gap_frac"))


def on_thresholds(df: DataFrame, keys: Sequence[str], *, floor_w: float = NOISE_FLOOR_W,
                  min_samples: int = MIN_ABOVE) -> DataFrame:
    """Half-median ON threshold per channel: thr_on_w, p50_on_w, n_above_floor,
    on_share_pct over all rows (missing ones too), method."""
    above = F.when(F.col("w") > floor_w, F.col("w"))
    q = exact_quantiles(df.withColumn("_ab", above), keys, {"p50": ("_ab", 0.5)}, {"n_above_floor": "_ab"})
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(q, list(keys), "left")
    base = base.withColumn("n_above_floor", F.coalesce("n_above_floor", F.lit(0)))
    few = F.col("n_above_floor") < min_samples
    half = round_even(F.greatest(F.lit(floor_w), 0.5 * F.col("p50")), 1)
    base = base.select("*", F.when(few, F.lit(floor_w)).otherwise(half).alias("thr_on_w"),
                       F.coalesce(round_even("p50", 1), F.lit(0.0)).alias("p50_on_w"),
                       F.when(few, "noise_floor").otherwise("half_p50").alias("method"))
    base = cut_lineage(base)  # one row per channel, read twice below
    on = (join_dim(df, base.select(*keys, "thr_on_w"), keys)
          .groupBy(*keys).agg(F.count_if(F.col("w") > F.col("thr_on_w")).alias("_on")))
    return (base.join(on, list(keys))
            .select(*keys, "thr_on_w", "p50_on_w", "n_above_floor", "method",
                    F.when(F.col("method") == "half_p50", round_even(100.0 * F.col("_on") / F.col("_n"), 2)).alias("on_share_pct")))


def floor_thresholds(df: DataFrame, keys: Sequence[str], *, noise_w: float = NOISE_FLOOR_W) -> DataFrame:
    """Threshold for channels with a standing draw: the p5 floor is taken off first."""
    d = with_quantiles(df, keys, {"floor_w": ("w", 0.05)})
    d = d.withColumn("_ab", F.when(F.col("w") > F.col("floor_w") + noise_w, F.col("w")))
    q = exact_quantiles(d, [*keys, "floor_w"], {"p50_on_w": ("_ab", 0.5)})
    base = d.select(*keys, "floor_w").groupBy(*keys).agg(F.max("floor_w").alias("floor_w")).join(
        q.drop("floor_w"), list(keys), "left")
    p50 = F.coalesce("p50_on_w", F.col("floor_w") + noise_w)
    return base.select(*keys, "floor_w", p50.alias("p50_on_w"),
                       (F.col("floor_w") + F.greatest(F.lit(noise_w), 0.5 * (p50 - F.col("floor_w")))).alias("thr_on_w"))


def on_level(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with `on`: above 5 W and above 2 % of the channel's p95."""
    d = with_quantiles(df, keys, {"p95_w": ("w", 0.95)})
    return d.withColumn("on", F.col("w") > F.greatest(F.lit(5.0), 0.02 * F.col("p95_w")))


def always_on_floor(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over days of each day's p10."""
    day = exact_quantiles(df.withColumn("_day", bucket_of("ts_us", DAY_US)), [*keys, "_day"], {"p10": ("w", 0.1)})
    return day.groupBy(*keys).agg(F.percentile("p10", 0.5).alias("always_on_w"))  # one value a day


def robust_noise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p10 floor and 1.4826 x MAD (at least 1 W) over all rows."""
    d = with_quantiles(df.select(*keys, "w"), keys, {"floor_w": ("w", 0.1), "_med": ("w", 0.5)})
    d = d.withColumn("_dev", F.abs(F.col("w") - F.col("_med")))
    q = exact_quantiles(d, [*keys, "floor_w"], {"mad": ("_dev", 0.5)})
    return q.select(*keys, "floor_w", F.greatest(1.4826 * F.col("mad"), F.lit(1.0)).alias("sigma_off_w"))


def channel_battery(df: DataFrame, keys: Sequence[str], *, gap_samples: int = 2, chunk_us: int = DAY_US) -> DataFrame:
    """One row per channel: counts, extrema, floor, cadence, threshold, ON share,
    energy at constant cadence, episodes and their dwell (samples x cadence)."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("w").isNull()).alias("n_missing"), F.min("w").alias("vmin"),
        F.max("w").alias("vmax"), F.count_if(F.col("w") < 0).alias("n_neg"), F.avg("w").alias("mean_w"),
        F.sum("w").alias("_sum"), ((F.max("ts_us") - F.min("ts_us")) / 86400e6).alias("span_days"))
    q = exact_quantiles(df.withColumn("_ab", F.when(F.col("w") > NOISE_FLOOR_W, F.col("w"))), keys,
                        {"floor_w": ("w", 0.05), "p50_on_w": ("_ab", 0.5)})
    base = base.join(q, keys, "left").join(cadence(df, keys, chunk_us=chunk_us), keys, "left")
    base = base.withColumn("thr_on_w", F.coalesce(F.greatest(F.lit(NOISE_FLOOR_W), 0.5 * F.col("p50_on_w")), F.lit(NOISE_FLOOR_W)))
    base = cut_lineage(base)  # one row per channel, read three times below
    d = join_dim(df.where("w is not null"), base.select(*keys, "thr_on_w"), keys)
    share = d.groupBy(*keys).agg(F.avg((F.col("w") > F.col("thr_on_w")).cast("int")).alias("on_share"))
    ep = sample_episodes(d, keys, F.col("w") > F.col("thr_on_w"), gap_samples=gap_samples, chunk_us=chunk_us)
    dw = exact_quantiles(ep, keys, {f"_d{p}": ("n_samples", p / 100) for p in (10, 50, 90)}, {"episodes": "n_samples"})
    out = base.join(share, keys, "left").join(dw, keys, "left")
    return out.select(
        *keys, "n", "n_missing", "n_neg", "vmin", "vmax", "mean_w", "floor_w", "dt_med_s", "span_days", "p50_on_w",
        "thr_on_w", "on_share", (F.col("_sum") * F.col("dt_med_s") / 3.6e6).alias("energy_kwh"),
        F.coalesce("episodes", F.lit(0)).alias("episodes"),
        (F.coalesce("episodes", F.lit(0)) / F.greatest("span_days", F.lit(1e-9))).alias("episodes_per_day"),
        *[(F.col(f"_d{p}") * F.col("dt_med_s")).alias(f"dwell_p{p}_s") for p in (10, 50, 90)])


def scan_groups(df: DataFrame, keys: Sequence[str], *, offset_h: int = 0, minutes_days: int = 21) -> DataFrame:
    """Hour, weekday, 5 W histogram and first-days minute sums from one scan."""
    keys = list(keys)
    w = F.col("w")
    t0 = df.groupBy(*keys).agg(F.min("ts_us").alias("_t0"))
    d = join_dim(df.where("w is not null"), t0, keys)
    d = d.select(*keys, "w", F.pmod(bucket_of("ts_us", 3_600_000_000) + offset_h, F.lit(24)).alias("hour"),
                 F.pmod(bucket_of("ts_us", DAY_US) + 3, F.lit(7)).alias("weekday"),
                 F.when((w >= 0) & (w <= 6000), F.least(F.floor(w / 5), F.lit(1199))).alias("bin"),
                 F.when(F.col("ts_us") < F.col("_t0") + minutes_days * DAY_US,
                        bucket_of(F.col("ts_us") - F.col("_t0"), 60_000_000)).alias("minute"))
    sets = [[*[F.col(k) for k in keys], F.col(c)] for c in ("hour", "weekday", "bin", "minute")]
    g = d.groupingSets(sets, *keys, "hour", "weekday", "bin", "minute").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum_w"), F.grouping("hour").alias("gh"),
        F.grouping("weekday").alias("gw"), F.grouping("bin").alias("gb"))
    kind = (F.when(F.col("gh") == 0, "hour").when(F.col("gw") == 0, "weekday").when(F.col("gb") == 0, "bin").otherwise("minute"))
    return (g.select(*keys, kind.alias("kind"), F.coalesce("hour", "weekday", "bin", "minute").alias("slot"), "n",
                     (F.col("sum_w") / F.col("n")).alias("mean_w")).where("slot is not null"))


def step_counts(df: DataFrame, keys: Sequence[str], levels: Sequence[float] = (30, 100, 300), *,
                chunk_us: int = DAY_US) -> DataFrame:
    d = with_previous(df, keys, ["w"], chunk_us=chunk_us)
    s = F.abs(F.col("w") - F.col("prev_w"))
    return d.groupBy(*keys).agg(*[F.count_if(s >= v).alias(f"steps_{int(v)}") for v in levels])


def psi(new: DataFrame, ref: DataFrame, keys: Sequence[str], value: str = "w", bins: int = 10) -> DataFrame:
    """Population stability index of `new` against quantile bins of `ref`."""
    keys = list(keys)
    edges = exact_quantiles(ref, keys, {f"e{i}": (value, i / bins) for i in range(1, bins)})
    edges = cut_lineage(edges.select(*keys, F.array(*[f"e{i}" for i in range(1, bins)]).alias("_edges")))  # one row per key, read three times

    def share(df, out):
        hit = F.size(F.filter("_edges", lambda e: e <= F.col(value)))
        d = join_dim(df.where(F.col(value).isNotNull()), edges, keys)
        c = d.groupBy(*keys, hit.alias("_bin")).agg(F.count(F.lit(1)).alias(out))
        return c

    slots = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    on = [*keys, "_bin"]
    j = slots.join(share(new, "_cn"), on, "left").join(share(ref, "_cr"), on, "left").fillna(0, ["_cn", "_cr"])
    tot = j.groupBy(*keys).agg(F.sum("_cn").alias("_tn"), F.sum("_cr").alias("_tr"))
    j = j.join(tot, keys) if keys else j.crossJoin(F.broadcast(tot))
    pn = F.greatest(F.col("_cn") / F.greatest("_tn", F.lit(1)), F.lit(1e-6))
    pr = F.greatest(F.col("_cr") / F.greatest("_tr", F.lit(1)), F.lit(1e-6))
    return j.groupBy(*keys).agg(F.sum((pn - pr) * F.ln(pn / pr)).alias("psi"))


def sample_moments(df: DataFrame, keys: Sequence[str], value: str = "w") -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, distinct values."""
    n = F.col("n")
    g1, g2 = F.col("_g1"), F.col("_g2")
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"))
    d = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.count(value).alias("n_distinct"))
    return m.join(d, list(keys)).select(
        *keys, "n", "n_distinct", (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"))


def prf(matched: Column, pred: Column, truth: Column) -> list[Column]:
    """precision, recall, f1 with 0 for empty denominators."""
    p = F.when(pred > 0, matched / pred).otherwise(0.0)
    r = F.when(truth > 0, matched / truth).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def band_verdict(ratio: Column, lo: Column, hi: Column) -> Column:
    return F.when((ratio >= lo) & (ratio <= hi), "PASS").otherwise("FLAG")


def psi_verdict(v: Column) -> Column:
    return F.when(v < 0.1, "PASS").when(v < 0.25, "MODERATE").otherwise("FLAG")


def physics_verdict(st: Mapping[str, Column]) -> Column:
    """Load class of a channel from its battery; first rule that fits wins."""
    duty, p50, vmax = st["on_share"], st["p50_on_w"], st["vmax"]
    return (F.when(st["n"] == 0, "EMPTY")
            .when(100.0 * st["n"] / F.greatest(st["n_all"], F.lit(1)) < 5, "ZOMBIE")
            .when(vmax < 100, "NEAR-DEAD").when(p50 >= 1000, "HEATER")
            .when(duty.between(0.08, 0.60) & (p50 >= 30) & (p50 < 1000) & (st["episodes_per_day"] >= 1), "COMPRESSOR")
            .when((vmax >= 1500) & (duty < 0.08), "EPISODIC-HIGH")
            .when((duty > 0.60) & (p50 < 100), "STANDBY-PLATEAU").when(p50 < 20, "TRICKLE").otherwise("WEAK"))


# fixed values: label words that announce a heating or a cooling load
HEAT_WORDS = ("kettle", "microwave", "iron", "toaster", "hair dryer", "space heater", "spin dryer", "coffee", "oven",
              "washing machine", "dish washer", "dishwasher")
COLD_WORDS = ("fridge", "freezer", "refrigerat", "air handling", "ventilation")


def expected_verdicts(label: Column) -> Column:
    """Verdicts a label makes plausible; null when the label says nothing."""
    low = F.lower(label)
    return (F.when((low == "") | low.rlike("site|outlet|light"), None)
            .when(low.rlike("|".join(HEAT_WORDS)), F.array(F.lit("HEATER"), F.lit("EPISODIC-HIGH")))
            .when(low.rlike("|".join(COLD_WORDS)), F.array(F.lit("COMPRESSOR")))
            .when(low.contains("vacuum"), F.array(F.lit("EPISODIC-HIGH")))
            .otherwise(F.array(F.lit("TRICKLE"), F.lit("STANDBY-PLATEAU"), F.lit("WEAK"))))


def register_integral(register: DataFrame, readings: DataFrame, keys: Sequence[str], *, max_hold_s: float, unit_wh: float = 1.0, chunk_us: int = DAY_US) -> DataFrame:
    """keys, span (last less first count), naive_ratio (sum of rises over span), integral (power held at most
    `max_hold_s`, in register units) and gap_share, the difference of span and integral over the span."""
    keys = list(keys)
    d = ordered_scan(register, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), lag={"_p": "k"})
    pos = F.struct("ts_us", "seq")
    s = d.groupBy(*keys).agg((F.max_by("k", pos) - F.min_by("k", pos)).alias("span"), F.sum(F.greatest(F.col("k") - F.col("_p"), F.lit(0))).alias("_rises"))
    e = hold_energy(readings, keys, max_hold_s, chunk_us=chunk_us).groupBy(*keys).agg((F.coalesce(F.sum("e_wh"), F.lit(0.0)) / unit_wh).alias("integral"))
    whole = F.when(F.col("span") != 0, F.col("span"))
    return s.join(e, keys).select(*keys, "span", (F.coalesce("_rises", F.lit(0)) / whole).alias("naive_ratio"), "integral", (F.abs(F.col("span") - F.col("integral")) / F.abs(whole)).alias("gap_share"))


def wrap_sizes(register: DataFrame, keys: Sequence[str], *, least: int, chunk_us: int = DAY_US) -> DataFrame:
    """keys, unit (smallest drop of at least `least`), n_drops of that kind, n_wraps (whole multiples of the unit), largest."""
    keys = list(keys)
    d = ordered_scan(register, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), lag={"_p": "k"}).select(*keys, (F.col("_p") - F.col("k")).alias("_drop")).where(F.col("_drop") >= least)
    per = d.groupBy(*keys, "_drop").agg(F.count(F.lit(1)).alias("n"))
    unit = per.groupBy(*keys).agg(F.min("_drop").alias("unit"))
    return per.join(unit, keys).groupBy(*keys, "unit").agg(F.sum("n").alias("n_drops"), F.sum(F.when(F.col("_drop") % F.col("unit") == 0, F.col("n")).otherwise(0)).alias("n_wraps"), F.max("_drop").alias("largest"))


def dead_by_energy(df: DataFrame, keys: Sequence[str], *, least_kwh: float = 0.5, max_hold_s: float = 30.0, chunk_us: int = DAY_US) -> DataFrame:
    """keys, kwh (held readings) and `dead`, below `least_kwh` over the whole span."""
    e = hold_energy(df, keys, max_hold_s, chunk_us=chunk_us).groupBy(*keys).agg((F.coalesce(F.sum("e_wh"), F.lit(0.0)) / 1000).alias("kwh"))
    return e.withColumn("dead", F.col("kwh") < least_kwh)
