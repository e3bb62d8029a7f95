"""As-of, nearest, interval and overlap joins as bucketed equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import DAY_US, bucket_of, ordered_scan, time_halo


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str], *,
              tolerance_us: int, direction: str = "backward", ts: str = "ts_us",
              right_ts: str = "ts_us", chunk_us: int = DAY_US, prefix: str = "r_",
              tie: str = "later") -> DataFrame:
    """Attach to every left row the right row at or before / at or after / nearest.

    Only right rows within `tolerance_us` qualify, so each left chunk needs just
    that much halo and the join is one shuffle by (key, chunk). `tie` picks the
    later or the earlier sample at equal distance. Adds `prefix + name` for
    each payload column and `prefix + "ts_us"`; left rows without a partner stay.
    """
    keys = list(keys)
    back = tolerance_us if direction in ("backward", "nearest") else 0
    ahead = tolerance_us if direction in ("forward", "nearest") else 0
    pay = F.struct(F.col(right_ts).alias("_t"), *[F.col(c) for c in payload])
    r = (time_halo(right, right_ts, chunk_us, back, ahead)
         .select(*keys, "_chunk", F.col(right_ts).alias("_t"), pay.alias("_pay"),
                 F.lit(None).cast(_struct_of(left)).alias("_left")))
    lf = left.select(*keys, bucket_of(ts, chunk_us).alias("_chunk"), F.col(ts).alias("_t"),
                     F.lit(None).cast(r.schema["_pay"].dataType).alias("_pay"),
                     F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    both = lf.unionByName(r)
    # range frames: right rows with the same stamp are peers and count as a match
    up = W.partitionBy(*keys, "_chunk").orderBy(F.col("_t")).rangeBetween(W.unboundedPreceding, 0)
    dn = W.partitionBy(*keys, "_chunk").orderBy(F.col("_t").desc()).rangeBetween(W.unboundedPreceding, 0)
    cols = ["*"]
    if back:
        cols.append(F.max("_pay").over(up).alias("_b"))
    if ahead:
        cols.append(F.min("_pay").over(dn).alias("_f"))
    hit = both.select(*cols).where(F.col("_left").isNotNull())
    hit = hit if back else hit.withColumn("_b", F.lit(None).cast(r.schema["_pay"].dataType))
    hit = hit if ahead else hit.withColumn("_f", F.lit(None).cast(r.schema["_pay"].dataType))
    db = F.when(F.col("_t") - F.col("_b._t") <= tolerance_us, F.col("_t") - F.col("_b._t"))
    df_ = F.when(F.col("_f._t") - F.col("_t") <= tolerance_us, F.col("_f._t") - F.col("_t"))
    later = df_ <= db if tie == "later" else df_ < db
    pick = (F.when(db.isNull(), F.when(df_.isNotNull(), F.col("_f")))
            .when(df_.isNull(), F.col("_b")).when(later, F.col("_f")).otherwise(F.col("_b")))
    return (hit.withColumn("_x", pick)
            .select("_left.*", F.col("_x._t").alias(prefix + "ts_us"),
                    *[F.col(f"_x.{c}").alias(prefix + c) for c in payload]))


def _struct_of(df: DataFrame):
    return df.schema


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str], *,
                ts: str = "ts_us", chunk_us: int = DAY_US, prefix: str = "r_") -> DataFrame:
    """As-of backward without an age limit: a carried forward fill over the union.

    Among right rows of one stamp the largest payload wins (`next_after`: the smallest).
    """
    keys = list(keys)
    pay = F.struct(F.col(ts).alias("_t"), *[F.col(c) for c in payload])
    r = right.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), pay.alias("_pay"),
                     F.lit(None).cast(left.schema).alias("_left"))
    lf = left.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(r.schema["_pay"].dataType).alias("_pay"),
                     F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    out = ordered_scan(lf.unionByName(r), keys, ["_t", "_side", "_pay"], bucket_of("_t", chunk_us),
                       ffill={"_x": "_pay"}).where("_side = 1")
    return out.select("_left.*", F.col("_x._t").alias(prefix + "ts_us"),
                      *[F.col(f"_x.{c}").alias(prefix + c) for c in payload])


def next_after(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str], *,
               ts: str = "ts_us", chunk_us: int = DAY_US, strict: bool = False,
               prefix: str = "n_") -> DataFrame:
    """First right row at or after (strictly after with `strict`) each left row."""
    keys = list(keys)
    pay = F.struct(F.col(ts).alias("_t"), *[F.col(c) for c in payload])
    side = 0 if strict else 2
    r = right.select(*keys, F.col(ts).alias("_t"), F.lit(side).alias("_side"), pay.alias("_pay"),
                     F.lit(None).cast(left.schema).alias("_left"))
    lf = left.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(r.schema["_pay"].dataType).alias("_pay"),
                     F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    out = ordered_scan(lf.unionByName(r), keys, ["_t", "_side", "_pay"], bucket_of("_t", chunk_us),
                       bfill={"_x": "_pay"}).where("_side = 1")
    return out.select("_left.*", F.col("_x._t").alias(prefix + "ts_us"),
                      *[F.col(f"_x.{c}").alias(prefix + c) for c in payload])


def points_in(points: DataFrame, spans: DataFrame, keys: Sequence[str], *, start: str, end: str,
              ts: str = "ts_us", bucket_us: int = DAY_US, closed: str = "both",
              how: str = "inner", salts: int = 1) -> DataFrame:
    """Readings joined to the spans that hold them.

    Spans are copied into the time buckets they touch, so a hot meter is spread
    over its buckets; `salts` splits a bucket further by copying the spans.
    `closed` is both | left | right | neither. `how` may be inner, left_semi or
    left_anti (each point lies in exactly one bucket, so these stay exact).
    """
    keys = list(keys)
    p = points.withColumn("_b", bucket_of(ts, bucket_us))
    s = spans.withColumn("_b", F.explode(F.sequence(bucket_of(start, bucket_us),
                                                    F.greatest(bucket_of(start, bucket_us),
                                                               bucket_of(end, bucket_us)))))
    on = [*keys, "_b"]
    if salts > 1:
        p = p.withColumn("_z", F.pmod(F.xxhash64(ts), F.lit(salts)).cast("int"))
        s = s.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("_z")
    a, b = p.alias("a"), s.alias("b")
    t, s0, s1 = F.col(f"a.{ts}"), F.col(f"b.{start}"), F.col(f"b.{end}")
    lo = t >= s0 if closed in ("both", "left") else t > s0
    hi = t <= s1 if closed in ("both", "right") else t < s1
    cond = lo & hi
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    j = a.join(b, cond, how)
    keep_a = [F.col(f"a.{c}") for c in points.columns]
    if how in ("left_semi", "left_anti"):
        return j.select(*keep_a)
    return j.select(*keep_a, *[F.col(f"b.{c}") for c in spans.columns if c not in keys])


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 bucket_us: int = DAY_US, extra: Column | None = None,
                 touch: bool = False) -> DataFrame:
    """All pairs of overlapping intervals, once each, as structs `l` and `r`.

    Both sides are copied into the buckets they touch; a pair is kept only in
    the bucket that holds the later start, so no distinct is needed. `touch`
    also keeps pairs that share just an end point.
    """
    keys = list(keys)
    (ls, le), (rs, re_) = left_span, right_span

    def spread(df, s, e, name):
        b = F.explode(F.sequence(bucket_of(s, bucket_us),
                                 F.greatest(bucket_of(s, bucket_us), bucket_of(e, bucket_us))))
        return df.select(*keys, b.alias("_b"), F.struct(*[F.col(c) for c in df.columns]).alias(name))

    a, b = spread(left, ls, le, "l"), spread(right, rs, re_, "r")
    j = a.join(b, [*keys, "_b"])
    s0, e0, s1, e1 = (F.col(f"l.{ls}"), F.col(f"l.{le}"), F.col(f"r.{rs}"), F.col(f"r.{re_}"))
    over = ((s0 <= e1) & (s1 <= e0)) if touch else ((s0 < e1) & (s1 < e0))
    cond = over & (F.col("_b") == bucket_of(F.greatest(s0, s1), bucket_us))
    if extra is not None:
        cond = cond & extra
    return j.where(cond).select(*keys, "l", "r")


def overlap_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
                 left_span: tuple[str, str], right_span: tuple[str, str], out: str,
                 left_id: Sequence[str], bucket_us: int = DAY_US,
                 extra: Column | None = None, touch: bool = False) -> DataFrame:
    """Left rows with a boolean: some right interval overlaps (semi-join as a flag)."""
    hit = (overlap_join(left, right, keys, left_span=left_span, right_span=right_span,
                        bucket_us=bucket_us, extra=extra, touch=touch)
           .select(*keys, *[F.col(f"l.{c}").alias(c) for c in left_id if c not in keys]).distinct()
           .withColumn("_hit", F.lit(True)))
    on = list(dict.fromkeys([*keys, *left_id]))
    return left.join(hit, on, "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def overlap_count(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_span: tuple[str, str], right_span: tuple[str, str],
                  left_id: Sequence[str], out: str, other: str | None = None, touch: bool = False, chunk_us: int = DAY_US) -> DataFrame:
    """Left rows with the number of right intervals that overlap theirs; no pair is ever built.

    The number is a difference of ranks: starts before the interval's end less ends before its start, both
    running counts over the end points of one key, so the rows stay linear in the input however many intervals
    overlap. `touch` also counts intervals that share just an end point (a reading is an interval of no
    length). With `other`, intervals of the same value in that column are not counted. `keys` and `left_id`
    together name a left row; intervals end no earlier than they start.
    """
    keys, ident = list(keys), list(dict.fromkeys([*keys, *left_id]))
    (ls, le), (rs, re_) = left_span, right_span

    def counted(by: list[str], name: str) -> DataFrame:
        point = F.col(rs) == F.col(re_)  # of no length: inside only if strictly between the ends
        one = lambda c: F.when(c, 1).otherwise(0)
        flat = F.lit(touch) | ~point
        ends = [F.struct(F.col(rs).alias("t"), one(flat).alias("s"), F.lit(0).alias("e"), one(~flat).alias("z")),
                F.struct(F.col(re_).alias("t"), F.lit(0).alias("s"), one(flat).alias("e"), F.lit(0).alias("z"))]
        ids = [F.lit(None).cast(left.schema[c].dataType).alias(f"_i{i}") for i, c in enumerate(ident)]
        r = right.select(*by, F.explode(F.array(*ends)).alias("x"), *ids).select(*by, "x.*", F.lit(1).alias("_p"), *[f"_i{i}" for i in range(len(ident))])
        # at equal stamps: what is asked of the end comes before the starts there, unless touching counts, and the other way round
        asks = [F.struct(F.col(le).alias("t"), F.lit(2 if touch else 0).alias("_p")), F.struct(F.col(ls).alias("t"), F.lit(0 if touch else 2).alias("_p"))]
        q = left.select(*by, F.posexplode(F.array(*asks)).alias("_at", "x"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(ident)])
        q = q.select(*by, F.col("x.t").alias("t"), *[F.lit(0).alias(c) for c in "sez"], F.col("x._p").alias("_p"), *[f"_i{i}" for i in range(len(ident))], "_at")
        both = r.withColumn("_at", F.lit(None).cast("int")).select(q.columns).union(q)
        ran = ordered_scan(both, by, ["t", "_p"], bucket_of("t", chunk_us), running_sum={"_s": "s", "_e": "e", "_z": "z"}).where("_at IS NOT NULL")
        at = lambda c, n: F.max(F.when(F.col("_at") == n, F.col(c)))
        got = ran.groupBy(*[f"_i{i}" for i in range(len(ident))]).agg((at("_s", 0) - at("_e", 1) + F.greatest(at("_z", 0) - at("_z", 1), F.lit(0))).alias(name))
        return got.select(*[F.col(f"_i{i}").alias(c) for i, c in enumerate(ident)], name)

    n = counted(keys, "_all")
    if other is not None:
        n = n.join(counted([*keys, other], "_same"), ident).select(*ident, (F.col("_all") - F.col("_same")).alias("_all"))
    return left.join(n, ident, "left").select(*left.columns, F.coalesce("_all", F.lit(0)).cast("bigint").alias(out))
