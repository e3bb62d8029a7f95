"""Calibration windows: what contaminates them, when quiet ones exist, and presses snapped to the step they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import step_signal, us
from .joins import overlap_count, points_in
from .ordered import DAY_US, bucket_of, merge_intervals, ordered_scan

HOUR_US = 3600 * 1_000_000


def contamination(ep: DataFrame, keys: Sequence[str], *, pad_s: float, edge_s: float, device: str = "device", chunk_us: int = DAY_US) -> DataFrame:
    """Episodes with n_inside, n_start, n_end: switch events of other devices in the window (padded by
    `pad_s`) and within `edge_s` of its two boundaries; `raw` and `harmful` say whether there are any."""
    keys, ident = list(keys), [device, "t_on_us"]
    events = ep.select(*keys, device, F.explode(F.array("t_on_us", "t_off_us")).alias("_t"))
    near = {"n_inside": (F.col("t_on_us") - us(pad_s), F.col("t_off_us") + us(pad_s)),
            "n_start": (F.col("t_on_us") - us(edge_s), F.col("t_on_us") + us(edge_s)),
            "n_end": (F.col("t_off_us") - us(edge_s), F.col("t_off_us") + us(edge_s))}
    out = ep
    for name, (a, z) in near.items():
        own = ep.select(*keys, *ident, a.alias("_a"), z.alias("_z"))
        n = overlap_count(own, events, keys, left_span=("_a", "_z"), right_span=("_t", "_t"), left_id=ident, out=name, other=device, touch=True, chunk_us=chunk_us)
        out = out.join(n.select(*keys, *ident, name), [*keys, *ident])
    return out.select(*ep.columns, *near, (F.col("n_inside") > 0).alias("raw"), (F.col("n_start") + F.col("n_end") > 0).alias("harmful"))


def free_stretches(ep: DataFrame, keys: Sequence[str], *, chunk_us: int = 32 * DAY_US) -> DataFrame:
    """t0_us, t1_us of the stretches between a key's first and last event in which no episode is open."""
    keys = list(keys)
    busy = merge_intervals(ep, keys, "t_on_us", "t_off_us", 0, overlapping=True, chunk_us=chunk_us)
    d = ordered_scan(busy, keys, ["t_on_us"], bucket_of("t_on_us", chunk_us), lag={"_e": "t_off_us"})
    return d.where(F.col("_e") < F.col("t_on_us")).select(*keys, F.col("_e").alias("t0_us"), F.col("t_on_us").alias("t1_us"))


def hours_of(spans: DataFrame, keys: Sequence[str], start: Column, end: Column) -> DataFrame:
    """keys, hour (of day), us: the clock time of spans in each hour of the day, cut at the hours' edges."""
    d = spans.select(*keys, start.alias("_a"), end.alias("_z")).where("_z > _a")
    d = d.withColumn("_h", F.explode(F.sequence(bucket_of("_a", HOUR_US), bucket_of(F.col("_z") - 1, HOUR_US))))
    part = F.least(F.col("_z"), (F.col("_h") + 1) * HOUR_US) - F.greatest(F.col("_a"), F.col("_h") * HOUR_US)
    return d.groupBy(*keys, F.pmod("_h", F.lit(24)).alias("hour")).agg(F.sum(part).alias("us"))


def quiet_share(ep: DataFrame, keys: Sequence[str], lengths_s: Sequence[float], *, chunk_us: int = 32 * DAY_US) -> DataFrame:
    """keys, hour, length_s, share: of the clock time between first and last event, the part at which a window
    of that length could begin and see no device switched on."""
    keys = list(keys)
    seen = ep.groupBy(*keys).agg(F.min("t_on_us").alias("a"), F.max("t_off_us").alias("z"))
    base = hours_of(seen, keys, F.col("a"), F.col("z")).withColumnRenamed("us", "_all")
    free = free_stretches(ep, keys, chunk_us=chunk_us).withColumn("length_s", F.explode(F.array(*[F.lit(float(x)) for x in lengths_s])))
    begin = hours_of(free, [*keys, "length_s"], F.col("t0_us"), F.col("t1_us") - (F.col("length_s") * 1e6).cast("bigint"))
    every = base.withColumn("length_s", F.explode(F.array(*[F.lit(float(x)) for x in lengths_s])))
    got = every.join(begin, [*keys, "hour", "length_s"], "left")
    return got.select(*keys, "hour", "length_s", (F.coalesce("us", F.lit(0)) / F.col("_all")).alias("share"))


def snap_to_step(marks: DataFrame, readings: DataFrame, keys: Sequence[str], ident: Sequence[str], *, at: str, within_s: float, rows: int, rising: bool = True,
                 bucket_us: int = DAY_US, out: str = "snapped_us") -> DataFrame:
    """Marks with the stamp of the largest coherent step within `within_s` of theirs, or their own where there is none.

    A step is the mean of `rows` readings from a reading on, less the mean of as many before it; `rising` wants the
    largest rise, otherwise the largest fall. Of equal steps the nearest to the mark counts, then the earlier.
    """
    keys, ident = list(keys), list(ident)
    steps = step_signal(readings.select(*keys, "ts_us", "seq", "w"), keys, rows, chunk_us=bucket_us).where("step IS NOT NULL")
    steps = steps.select(*keys, "ts_us", (F.col("step") if rising else -F.col("step")).alias("_size")).where("_size > 0")
    wide = marks.select(*keys, *ident, F.col(at).alias("_t"), (F.col(at) - us(within_s)).alias("_a"), (F.col(at) + us(within_s)).alias("_z"))
    met = points_in(steps, wide, keys, start="_a", end="_z", bucket_us=bucket_us)
    best = F.max(F.struct("_size", (-F.abs(F.col("ts_us") - F.col("_t"))).alias("near"), (-F.col("ts_us")).alias("early"))).alias("b")
    found = met.groupBy(*keys, *ident).agg(best).select(*keys, *ident, (-F.col("b.early")).alias("_s"))
    return marks.join(found, [*keys, *ident], "left").select(*marks.columns, F.coalesce("_s", F.col(at)).alias(out))


def level_between(marks: DataFrame, readings: DataFrame, keys: Sequence[str], ident: Sequence[str], *, start: str, end: str, base_s: float,
                  bucket_us: int = DAY_US, out: str = "level_w") -> DataFrame:
    """Marks with the mean of the readings in [start, end) less the mean over `base_s` before the start; null without either."""
    keys, ident = list(keys), list(ident)
    d = marks.select(*keys, *ident, F.col(start).alias("_a"), F.col(end).alias("_z"), (F.col(start) - us(base_s)).alias("_from"))
    met = points_in(readings.select(*keys, "ts_us", "w"), d, keys, start="_from", end="_z", bucket_us=bucket_us, closed="left")
    before = F.col("ts_us") < F.col("_a")
    got = met.groupBy(*keys, *ident).agg((F.avg(F.when(~before, F.col("w"))) - F.avg(F.when(before, F.col("w")))).alias(out))
    return marks.join(got, [*keys, *ident], "left")
