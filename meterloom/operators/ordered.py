"""Order-dependent operators that never put one whole meter into one task.

A plain window over a meter is one task per meter, and one meter may hold a
third of all rows. Everything here therefore works on (key, chunk) groups,
where a chunk is a slice of the ordering axis, and repairs the chunk edges:

* `ordered_scan`  keeps the rows; a per-chunk summary carries lag, fill,
  running sums and row numbers across edges (all are associative).
* `islands`       collapses rows to runs; only the first and last run of a
  chunk can continue in a neighbour, so a second pass looks at those alone.
* `time_halo` / `row_halo`  give a bounded frame the neighbours it can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY_US = 86_400_000_000

Cols = Mapping[str, "Column | str"]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capped(gap: Column, cap) -> Column:
    """min(gap, cap), null for a null gap (`least` alone would return the cap)."""
    return F.when(gap.isNotNull(), F.least(gap, cap if isinstance(cap, Column) else F.lit(cap)))


def bucket_of(c: Column | str, width: int | Column) -> Column:
    """Floor bucket number in exact integer arithmetic (also below zero)."""
    c = as_col(c).cast("bigint")
    w = width if isinstance(width, Column) else F.lit(int(width)).cast("bigint")
    return ((c - F.pmod(c, w)) / w).cast("bigint")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_dim(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", *,
             max_bytes: int = 64 << 20) -> DataFrame:
    """Join readings to a per-key table although one key may hold a third of them.

    The table is broadcast when its size estimate is below `max_bytes`. Beyond
    that it is a plain equi-join: adaptive execution sees the real sizes, broadcasts
    a small side after all, and splits a hot key's partition into as many tasks
    as its size asks for.
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(dim))  # a key-less aggregate: one row
    return df.join(F.broadcast(dim) if estimated_bytes(dim) <= max_bytes else dim, keys, how)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, *,
                 lag: Cols | None = None, lead: Cols | None = None,
                 ffill: Cols | None = None, bfill: Cols | None = None,
                 running_sum: Cols | None = None, running_max: Cols | None = None,
                 prior_max: Cols | None = None,
                 total: Cols | None = None, row_number: str | None = None) -> DataFrame:
    """Add order-dependent columns to every row, equal to the unchunked window.

    `chunk` must not decrease along `order`. Each mapping is output name to
    input column. `row_number` counts from 1; `total` is the key-wide sum;
    `prior_max` looks at the rows before the current one only. Rows with null
    keys form a group of their own, as in a plain window.
    """
    keys, order = list(keys), list(order)
    specs = {"lag": lag or {}, "lead": lead or {}, "ffill": ffill or {}, "bfill": bfill or {},
             "running_sum": running_sum or {}, "running_max": running_max or {},
             "prior_max": prior_max or {}, "total": total or {}}
    names = {(k, o): f"_{k}_{i}" for k, m in specs.items() for i, o in enumerate(m)}
    # structs are never null themselves and equal where their fields are both null, so groups,
    # windows and the join keep rows with null keys; windows and join need one shuffle of the
    # rows, the summary is summed up in each task before it moves
    grp = ["_key", "_chunk"]
    src = df.select("*", F.struct(*keys, F.lit(0).alias("_all")).alias("_key"), F.struct(chunk.cast("bigint").alias("n")).alias("_chunk"),
                    *[as_col(c).alias(names[k, o]) for k, m in specs.items() for o, c in m.items()])
    up = W.partitionBy(*grp).orderBy(*order)
    down = W.partitionBy(*grp).orderBy(*[F.col(o).desc() for o in order])
    upto = up.rowsBetween(W.unboundedPreceding, W.currentRow)
    downto = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = F.struct(*order)
    per_chunk = W.partitionBy("_key").orderBy("_chunk")
    before = per_chunk.rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("_key").orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)

    local, summary, carry, final = [], [], [], []

    def add(kind, out, loc, summ, car, fin):
        n = names.get((kind, out), "_rn")
        if loc is not None:
            local.append(loc.alias(n + "_l"))
        summary.append(summ.alias(n + "_s"))
        carry.append(car(F.col(n + "_s")).alias(n + "_c"))
        final.append(fin(F.col(n + "_l") if loc is not None else None, F.col(n + "_c")).alias(out))

    for o in specs["lag"]:
        v = F.struct(F.col(names["lag", o]).alias("v"))
        add("lag", o, F.lag(v).over(up), F.max_by(v, pos),
            lambda s: F.lag(s).over(per_chunk), lambda a, c: F.coalesce(a, c)["v"])
    for o in specs["lead"]:
        v = F.struct(F.col(names["lead", o]).alias("v"))
        add("lead", o, F.lead(v).over(up), F.min_by(v, pos),
            lambda s: F.lead(s).over(per_chunk), lambda a, c: F.coalesce(a, c)["v"])
    for o in specs["ffill"]:
        v = F.col(names["ffill", o])
        add("ffill", o, F.last(v, True).over(upto), F.max_by(v, F.when(v.isNotNull(), pos)),
            lambda s: F.last(s, True).over(before), F.coalesce)
    for o in specs["bfill"]:
        v = F.col(names["bfill", o])
        add("bfill", o, F.last(v, True).over(downto), F.min_by(v, F.when(v.isNotNull(), pos)),
            lambda s: F.last(s, True).over(after), F.coalesce)
    for o in specs["running_sum"]:
        v = F.col(names["running_sum", o])
        add("running_sum", o, F.sum(v).over(upto), F.sum(v), lambda s: F.sum(s).over(before),
            lambda a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)))
    for o in specs["running_max"]:
        v = F.col(names["running_max", o])
        add("running_max", o, F.max(v).over(upto), F.max(v), lambda s: F.max(s).over(before),
            lambda a, c: F.greatest(a, c))
    for o in specs["prior_max"]:
        v = F.col(names["prior_max", o])
        add("prior_max", o, F.max(v).over(up.rowsBetween(W.unboundedPreceding, -1)), F.max(v),
            lambda s: F.max(s).over(before), lambda a, c: F.greatest(a, c))
    for o in specs["total"]:
        v = F.col(names["total", o])
        add("total", o, None, F.sum(v), lambda s: F.sum(s).over(W.partitionBy("_key")),
            lambda a, c: c)
    if row_number:
        add("row_number", row_number, F.row_number().over(up), F.count(F.lit(1)),
            lambda s: F.sum(s).over(before),
            lambda a, c: (a + F.coalesce(c, F.lit(0))).cast("bigint"))

    carried = (src.groupBy(*grp).agg(*summary).select(*grp, *carry))
    rows = src.select(*df.columns, *grp, *local)
    return rows.join(carried, grp).select(*df.columns, *final)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, *,
            row: Cols, breaks: Callable[[Mapping[str, Column], Mapping[str, Column]], Column] | None = None,
            mark: Column | None = None, initial: Column | None = None,
            aggs: Mapping[str, tuple[str, Column]] | None = None,
            hold: tuple[str, int] | None = None) -> DataFrame:
    """Collapse ordered rows to islands in two passes over (key, chunk) groups.

    A new island starts where `breaks(previous row, this row)` holds or where
    the state changes. `mark` is the state of a row, null where the row leaves
    it undecided (hysteresis band): it is carried forward, from `initial` at
    the start of a key. `row` names the values `breaks` may see. `aggs` maps an
    output to (sum|min|max|first|last, input). `hold=(w, cap)` adds `hold_wus`:
    w times the gap on the first order column to the key's next row, capped.

    Output: keys, `first` and `last` structs of `row`, `n_rows`, `state` (with
    `mark`), `next` (first order value after the island, null at the end).
    """
    keys, order, names = list(keys), list(order), list(row)
    aggs = dict(aggs or {})
    has_state = mark is not None
    never = F.lit(False)
    oc = [f"_o{i}" for i in range(len(order))]
    grp = [*keys, "_chunk"]
    base = df.select(
        *keys, chunk.cast("bigint").alias("_chunk"), *[F.col(o).alias(c) for o, c in zip(order, oc)],
        *[as_col(c).alias(f"_r_{n}") for n, c in row.items()], *[c.alias(f"_a_{n}") for n, (_, c) in aggs.items()],
        *([mark.cast("int").alias("_m")] if has_state else []), *([as_col(hold[0]).cast("double").alias("_hw")] if hold else []))

    def fields(prefix):
        return {n: F.col(prefix + n) for n in names}

    # pass 1: islands inside a chunk
    win = W.partitionBy(*grp).orderBy(*oc)
    upto, prior = win.rowsBetween(W.unboundedPreceding, 0), win.rowsBetween(W.unboundedPreceding, -1)
    cols = [F.row_number().over(win).alias("_k"), F.lead("_o0").over(win).alias("_nx")]
    if breaks:
        cols += [F.lag(f"_r_{n}").over(win).alias(f"_p_{n}") for n in names]
    if has_state:
        cols += [F.last("_m", True).over(upto).alias("_fm"), F.last("_m", True).over(prior).alias("_pm")]
    base = base.select("*", *cols)
    new = F.col("_k") == 1
    if breaks:
        new = new | F.coalesce(breaks(fields("_p_"), fields("_r_")), F.lit(True))
    if has_state:
        new = new | ~F.col("_pm").eqNullSafe(F.col("_fm"))
    base = base.select("*", F.sum(new.cast("int")).over(upto).alias("_id"))
    one = {"sum": F.sum, "min": F.min, "max": F.max}

    def fold(kind, c, k):
        return F.min_by(c, k) if kind == "first" else F.max_by(c, k) if kind == "last" else one[kind](c)

    k = F.col("_k")
    part = [F.count(F.lit(1)).alias("n_rows"), F.max(F.col("_nx").isNull()).alias("_tail"), F.max_by("_nx", k).alias("_nx"),
            *[F.min_by(c, k).alias(c) for c in oc], *[F.min_by(f"_r_{n}", k).alias(f"_f_{n}") for n in names],
            *[F.max_by(f"_r_{n}", k).alias(f"_l_{n}") for n in names],
            *[fold(kind, F.col(f"_a_{n}"), k).alias(f"_u_{n}") for n, (kind, _) in aggs.items()]]
    if has_state:
        part.append(F.max("_fm").alias("_m"))
    if hold:
        e = F.col("_hw") * capped(F.col("_nx") - F.col("_o0"), hold[1])
        part += [F.sum(F.coalesce(e, F.lit(0.0))).alias("_e"), F.max_by("_hw", k).alias("_tw"), F.max_by("_o0", k).alias("_tt")]
    runs = base.groupBy(*grp, "_id").agg(*part)

    # pass 2: only islands at a chunk edge can go on in the neighbour chunk
    edge = (F.col("_id") <= (2 if has_state else 1)) | F.col("_tail")
    runs = runs.select("*", F.when(edge, F.lit(-1)).otherwise(F.col("_chunk")).alias("_g"))
    g2 = [*keys, "_g"]
    win2 = W.partitionBy(*g2).orderBy(*oc)
    upto2, prior2 = win2.rowsBetween(W.unboundedPreceding, 0), win2.rowsBetween(W.unboundedPreceding, -1)
    cols = [F.row_number().over(win2).alias("_k2"), F.lag("_chunk").over(win2).alias("_qc"), F.lead("_o0").over(win2).alias("_n2")]
    if breaks:
        cols += [F.lag(f"_l_{n}").over(win2).alias(f"_q_{n}") for n in names]
    if has_state:
        init = (initial if initial is not None else F.lit(0)).cast("int")
        cols += [F.coalesce(F.last("_m", True).over(upto2), init).alias("_s"), F.lag("_m").over(win2).alias("_qm"),
                 F.coalesce(F.last("_m", True).over(prior2), init).alias("_qs")]
    runs = runs.select("*", *cols)
    same = F.col("_qc") == F.col("_chunk")
    if has_state:
        same = (same & F.col("_qm").isNotNull()) | (F.col("_qs") != F.col("_s"))
    cut = F.coalesce(breaks(fields("_q_"), fields("_f_")), F.lit(True)) if breaks else never
    runs = runs.select("*", F.sum(((F.col("_k2") == 1) | F.coalesce(same, never) | cut).cast("int")).over(upto2).alias("_id2"))
    k2 = F.col("_k2")
    fin = [F.sum("n_rows").alias("n_rows"), F.max_by(F.when(F.col("_tail"), F.col("_n2")).otherwise(F.col("_nx")), k2).alias("next"),
           *[F.min_by(f"_f_{n}", k2).alias(f"_f_{n}") for n in names], *[F.max_by(f"_l_{n}", k2).alias(f"_l_{n}") for n in names],
           *[fold(kind, F.col(f"_u_{n}"), k2).alias(f"_u_{n}") for n, (kind, _) in aggs.items()]]
    if has_state:
        fin.append(F.max("_s").alias("state"))
    if hold:
        tail = F.when(F.col("_tail"), F.coalesce(F.col("_tw") * capped(F.col("_n2") - F.col("_tt"), hold[1]), F.lit(0.0))).otherwise(F.lit(0.0))
        fin.append(F.sum(F.col("_e") + tail).alias("hold_wus"))
    out = runs.groupBy(*g2, "_id2").agg(*fin)
    return out.select(*keys, F.struct(*[F.col(f"_f_{n}").alias(n) for n in names]).alias("first"),
                      F.struct(*[F.col(f"_l_{n}").alias(n) for n in names]).alias("last"), "n_rows", "next",
                      *(["state"] if has_state else []), *[F.col(f"_u_{n}").alias(n) for n in aggs],
                      *(["hold_wus"] if hold else []))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int | Column, *,
                    chunk_us: int = 32 * DAY_US, overlapping: bool = False,
                    aggs: Mapping[str, tuple[str, Column]] | None = None,
                    extra: Cols | None = None,
                    veto: Callable | None = None) -> DataFrame:
    """Join intervals whose distance is at most `gap`; output keys, start, end, n, aggs.

    `overlapping=True` compares with the running end of all earlier intervals,
    not only the previous one. `veto(prev, cur)` forces a cut.
    """
    keys = list(keys)
    gap_c = gap if isinstance(gap, Column) else F.lit(int(gap))
    row = {"s": start, "e": end, "gap": gap_c, **(extra or {})}
    chunk = bucket_of(start, chunk_us)
    if overlapping:
        df = ordered_scan(df, keys, [start, end], chunk, prior_max={"_reach": end})
        row["reach"] = F.col("_reach")
        cut = lambda p, c: F.coalesce((c["s"] - c["reach"]) > c["gap"], F.lit(True))
    else:
        cut = lambda p, c: (c["s"] - p["e"]) > c["gap"]
    brk = (lambda p, c: cut(p, c) | veto(p, c)) if veto else cut
    a = {"_end": ("max", as_col(end)), **{f"_m_{n}": v for n, v in (aggs or {}).items()}}
    out = islands(df, keys, [start, end], chunk, row=row, breaks=brk, aggs=a)
    return out.select(*keys, F.col("first.s").alias(start), F.col("_end").alias(end),
                      F.col("n_rows").alias("n_merged"),
                      *[F.col(f"_m_{n}").alias(n) for n in (aggs or {})])


def time_halo(df: DataFrame, ts: str, width_us: int, before_us: int, after_us: int) -> DataFrame:
    """Copy rows into every time chunk whose frames can reach them.

    Frames reach `before_us` back and `after_us` ahead. Adds `_chunk` and
    `_own` (true on the one copy that belongs to the chunk).
    """
    lo, hi = bucket_of(F.col(ts) - int(after_us), width_us), bucket_of(F.col(ts) + int(before_us), width_us)
    return (df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
            .withColumn("_own", F.col("_chunk") == bucket_of(ts, width_us)))


def row_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, *,
             before: int, after: int, rows_per_chunk: int = 1 << 18) -> DataFrame:
    """Number the rows of a key, cut them into equal chunks and add the
    `before`/`after` neighbour rows to each. Adds `_rn` (from 0), `_len` (rows of the
    key), `_chunk`, `_own`.

    Chunks hold the same number of rows whatever the density of the series.
    """
    df = (ordered_scan(df, keys, order, chunk, row_number="_rn", total={"_len": F.lit(1)})
          .withColumn("_rn", F.col("_rn") - 1))
    lo = bucket_of(F.greatest(F.col("_rn") - int(after), F.lit(0)), rows_per_chunk)
    hi = bucket_of(F.col("_rn") + int(before), rows_per_chunk)
    return (df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
            .withColumn("_own", F.col("_chunk") == bucket_of("_rn", rows_per_chunk)))


def halo_window(keys: Sequence[str], order: Sequence[str]):
    """The window a halo frame is evaluated in."""
    return W.partitionBy(*keys, "_chunk").orderBy(*order)


def suggest_chunk_us(df: DataFrame, keys: Sequence[str], ts: str = "ts_us",
                     target_rows: int = 2_000_000, finest_us: int = 60_000_000) -> int:
    """Widest power-of-two multiple of `finest_us` whose fullest chunk keeps `target_rows`."""
    fullest = (df.groupBy(*keys, bucket_of(ts, finest_us).alias("_b")).count()
               .agg(F.max("count").alias("m")).first()["m"] or 1)
    width = finest_us
    while fullest * 2 <= target_rows and width < 32 * DAY_US:
        width, fullest = width * 2, fullest * 2
    return width
