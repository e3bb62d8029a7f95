"""The energy conventions: hold, uncapped, capped, gap-dropping, constant cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import WUS_PER_WH, gaps, us
from .joins import points_in
from .ordered import DAY_US, bucket_of, capped, ordered_scan


def hold_energy(df: DataFrame, keys: Sequence[str], max_hold_s: float = 60.0, *,
                chunk_us: int = DAY_US) -> DataFrame:
    """Rows with e_wh: a reading holds until the next one, at most `max_hold_s`;
    the last reading of a key holds nothing."""
    g = gaps(df, keys, chunk_us=chunk_us, keep_last=True)
    hold = F.coalesce(capped(F.col("next_us") - F.col("ts_us"), us(max_hold_s)), F.lit(0))
    return g.withColumn("e_wh", F.col("w") * hold / WUS_PER_WH)


def cumulative_energy(df: DataFrame, keys: Sequence[str], max_hold_s: float = 60.0, *,
                      chunk_us: int = DAY_US) -> DataFrame:
    """Hold energy with its running total `cum_wh`."""
    e = hold_energy(df, keys, max_hold_s, chunk_us=chunk_us)
    return ordered_scan(e, keys, ["ts_us", "seq"], bucket_of("ts_us", chunk_us), running_sum={"cum_wh": "e_wh"})


def window_energy(df: DataFrame, windows: DataFrame, keys: Sequence[str], *, start: str, end: str,
                  max_hold_s: float = 60.0, chunk_us: int = DAY_US) -> DataFrame:
    """Hold energy of the readings inside [start, end], never negative."""
    e = hold_energy(df, keys, max_hold_s, chunk_us=chunk_us).select(*keys, "ts_us", "e_wh")
    got = (points_in(e, windows.select(*keys, start, end), keys, start=start, end=end, bucket_us=chunk_us)
           .groupBy(*keys, start, end).agg(F.sum("e_wh").alias("_e")))
    return (windows.join(got, [*keys, start, end], "left")
            .withColumn("energy_wh", F.greatest(F.coalesce("_e", F.lit(0.0)), F.lit(0.0))).drop("_e"))


def pair_energy(df: DataFrame, keys: Sequence[str], *, cap_s: float | None = None, drop_over_s: float | None = None,
                chunk_us: int = DAY_US, group: Sequence[Column] = ()) -> DataFrame:
    """Left-Riemann energy over neighbouring rows that both carry a value.

    Uncapped by default; `cap_s` bounds a gap, `drop_over_s` ignores longer ones.
    """
    g = gaps(df, keys, chunk_us=chunk_us, values=["w"])
    dt = F.col("dt_s") if cap_s is None else F.least(F.col("dt_s"), F.lit(float(cap_s)))
    if drop_over_s is not None:
        dt = F.when(dt <= drop_over_s, dt).otherwise(F.lit(0.0))
    both = F.col("w").isNotNull() & F.col("next_w").isNotNull()
    return g.groupBy(*keys, *group).agg(
        (F.sum(F.when(both, F.col("w") * dt)) / 3.6e6).alias("energy_kwh"),
        F.count_if(both).alias("n_pairs"))


def energy_balance(total: Column, attributed: Column, floor: Column) -> list[Column]:
    """residual_wh and residual_share of total - attributed - floor."""
    resid = total - attributed - floor
    return [resid.alias("residual_wh"), F.when(total != 0, resid / total).alias("residual_share")]
