"""Small column expressions: clocks, units, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ordered import DAY_US, as_col, bucket_of

HOUR_US = 3_600_000_000


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def hour_of(ts_us: Column | str, offset_h: int = 0) -> Column:
    return F.pmod(bucket_of(ts_us, HOUR_US) + offset_h, F.lit(24))


def weekday_of(ts_us: Column | str) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return F.pmod(bucket_of(ts_us, DAY_US) + 3, F.lit(7))


def month_key(ts_us: Column | str) -> Column:
    return F.date_format(F.timestamp_micros(as_col(ts_us)), "yyyyMM").cast("bigint")


def local_us(ts_us: Column | str, zone: str) -> Column:
    """Wall clock of `zone` as naive microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(as_col(ts_us)), zone))


def epoch_unit_us(v: Column) -> Column:
    """Microseconds from an epoch number in s, ms, us or ns, told apart by size."""
    v = v.cast("double")
    a = F.abs(v)
    return F.when(a > 1e17, v / 1e3).when(a > 1e14, v).when(a > 1e11, v * 1e3).otherwise(v * 1e6).cast("bigint")


def state_bit(state: Column, device: int) -> Column:
    return F.shiftright(state, device).bitwiseAND(1)


def on_step_of(w: Column, step: float = 10.0) -> Column:
    """Value sits on a staircase of `step`."""
    return F.abs(w - step * F.bround(w / step)) < 1e-9
