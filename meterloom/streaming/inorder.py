"""Stateful rules over readings in stamp order, whatever the order of their arrival.

A key's readings wait in map state, packed by time slot, until the watermark has passed their slot;
an event-time timer then releases whole slots in order. A row that is late, but not behind the watermark,
therefore changes nothing in the result. A rule folds one slot at a time as arrays: what it carries
is a small value state. What a key keeps is its slots of the watermark's length; what a task holds at
once is one slot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

US = 1_000_000
ROW = np.dtype([("t", "<i8"), ("seq", "<i8"), ("w", "<f8")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """What is done with the readings of one key, slot by slot."""

    carry: str  # schema of what is carried from slot to slot
    first: tuple  # its value before any reading
    out: str  # schema of the rows that come out, without the keys

    def fold(self, carry: tuple, t: np.ndarray, w: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        """The carry after these readings, and columns of what they complete."""
        raise NotImplementedError

    def wakes_at(self, carry: tuple) -> int | None:
        """Stamp at which silence means something, if any."""
        return None

    def silent(self, carry: tuple) -> tuple[tuple, dict[str, np.ndarray]]:
        """As fold, once the watermark has passed that stamp."""
        raise NotImplementedError


class Hysteresis(Rule):
    """ON from a reading of at least `hi` to one of at most `lo`, or over `idle_us` without any; others (null too) keep the state.
    An episode ends at its last ON reading."""

    carry = "on boolean, start bigint, last_on bigint, n bigint, seen bigint"
    first = (False, 0, 0, 0, 0)
    out = "t_on_us bigint, t_off_us bigint, n_rows bigint, timed_out boolean"

    def __init__(self, hi: float, lo: float, idle_us: int | None = None):
        self.hi, self.lo, self.idle = hi, lo, idle_us

    def fold(self, carry, t, w):
        on0, start, last_on, n, seen = carry
        rises, falls = w >= self.hi, w <= self.lo
        quiet = np.diff(t, prepend=seen if on0 or seen else t[0]) > self.idle if self.idle is not None else np.zeros(len(t), bool)
        decided = rises | falls | quiet
        last = np.maximum.accumulate(np.where(decided, np.arange(len(t)), -1))
        on = np.where(last >= 0, rises[last], on0)
        before = np.concatenate(([on0], on[:-1]))
        begins = on & (~before | quiet)
        # the episode every ON reading belongs to: 0 is the one carried in
        number = np.cumsum(begins)
        many = int(number[-1]) + 1
        rows = np.bincount(number[on], minlength=many)
        starts = np.concatenate(([start], t[begins]))
        ends = np.full(many, last_on)
        np.maximum.at(ends, number[on], t[on])
        rows[0] += n if on0 else 0
        open_end = bool(on[-1])
        closed = np.flatnonzero(rows[:many - 1] if open_end else rows)
        # how each closed one ended: the first reading behind it that is not part of it
        cut = np.flatnonzero(before & (~on | quiet))
        out = {"t_on_us": starts[closed], "t_off_us": ends[closed], "n_rows": rows[closed], "timed_out": quiet[cut]}
        return (open_end, int(starts[-1]), int(ends[-1]), int(rows[-1]) if open_end else 0, int(t[-1])), out

    def wakes_at(self, carry):
        on, _, _, _, seen = carry
        return seen + self.idle if self.idle is not None and on else None

    def silent(self, carry):
        _, start, last_on, n, seen = carry
        one = lambda x: np.array([x])
        return (False, 0, 0, 0, seen), {"t_on_us": one(start), "t_off_us": one(last_on), "n_rows": one(n), "timed_out": one(True)}


class Gaps(Rule):
    """A row for each silence of more than `gap_us`; next_us is -1 while it lasts."""

    carry = "seen bigint, told boolean"
    first = (-1, True)
    out = "last_us bigint, next_us bigint"

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def fold(self, carry, t, w):
        all_ = t if carry[0] < 0 else np.concatenate(([carry[0]], t))
        at = np.flatnonzero(np.diff(all_) > self.gap)
        return (int(t[-1]), False), {"last_us": all_[at], "next_us": all_[at + 1]}

    def wakes_at(self, carry):
        return None if carry[1] else carry[0] + self.gap

    def silent(self, carry):
        return (carry[0], True), {"last_us": np.array([carry[0]]), "next_us": np.array([-1])}


class HoldEnergy(Rule):
    """Energy so far: a reading holds until the next one, at most `cap_us`; null readings hold nothing."""

    carry = "t bigint, w double, total double"
    first = (-1, 0.0, 0.0)
    out = "ts_us bigint, energy_wh double"

    def __init__(self, cap_us: int):
        self.cap = cap_us

    def fold(self, carry, t, w):
        t0, w0, total = carry
        w = np.nan_to_num(w, nan=0.0)
        if t0 >= 0:
            t, w = np.concatenate(([t0], t)), np.concatenate(([w0], w))
        total += float((w[:-1] * np.minimum(np.diff(t), self.cap)).sum()) / 3.6e9
        return (int(t[-1]), float(w[-1]), total), {"ts_us": t[-1:], "energy_wh": np.array([total])}


class InOrder(StatefulProcessor):
    """Buffers the readings of a key and folds complete slots by a rule."""

    def __init__(self, rule: Rule, slot_us: int, keys: Sequence[str], order: str | None):
        self.rule, self.slot_us, self.keys, self.order = rule, slot_us, list(keys), order

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot bigint", "held binary")
        self.carry = handle.getValueState("carry", self.rule.carry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            held = np.zeros(len(part), ROW)
            held["t"] = part["ts_us"]
            held["w"] = part["w"].astype(float)
            if self.order:
                held["seq"] = part[self.order]
            slot = held["t"] // self.slot_us
            for s in np.unique(slot).tolist():
                old = self.slots.getValue((s,))
                if old is None:
                    self.handle.registerTimer((s + 1) * self.slot_us // 1000)
                self.slots.updateValue((s,), ((bytes(old[0]) if old else b"") + held[slot == s].tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        carry = tuple(self.carry.get()) if self.carry.exists() else self.rule.first
        due = sorted(s for (s,) in self.slots.keys() if (s + 1) * self.slot_us <= now)
        for s in due:
            held = np.frombuffer(bytes(self.slots.getValue((s,))[0]), ROW)
            held = held[np.lexsort((held["seq"], held["t"]))]
            carry, out = self.rule.fold(carry, held["t"], held["w"])
            self.slots.removeKey((s,))
            yield self._frame(key, out)
        wakes = self.rule.wakes_at(carry)
        if wakes is not None and wakes < now and not any((s * self.slot_us) <= wakes for (s,) in self.slots.keys()):
            carry, out = self.rule.silent(carry)
            yield self._frame(key, out)
        elif wakes is not None and (due or wakes >= now):
            self.handle.registerTimer(max(wakes, now) // 1000 + 1)
        self.carry.update(carry)

    def _frame(self, key, out: dict[str, np.ndarray]) -> pd.DataFrame:
        n = len(next(iter(out.values())))
        return pd.DataFrame({**{k: pd.Series([v] * n, dtype=object) for k, v in zip(self.keys, key)}, **out})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: Sequence[str], rule: Rule, *, late: str, slot_s: float, order: str | None = None) -> DataFrame:
    """The rule's rows for every key of a stream with ts, ts_us, w; rows more than `late` behind the newest stamp are dropped.

    Rows with a null key or stamp only move the watermark (heartbeats).
    """
    keys = list(keys)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for k in keys for f in stream.schema.fields if f.name == k) + rule.out
    needed = stream.select(*dict.fromkeys([*keys, "ts", "ts_us", "w", *([order] if order else [])])).withWatermark("ts", late)
    # the condition names ts, so that it stays above the watermark, which rows without keys move too
    whole = F.when(F.col("ts").isNull(), False).otherwise(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return needed.where(whole).groupBy(*keys).transformWithStateInPandas(InOrder(rule, int(slot_s * US), keys, order), schema, "append", "eventtime")


class state_store:
    """RocksDB holds the state of the queries started inside: it keeps it on disk, and state variables need it."""

    SET = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.SET}
        for k, v in self.SET.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
