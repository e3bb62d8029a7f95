"""One-to-one matching of detections to truth, and scores on top of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .episodes import us
from .joins import overlap_join, points_in
from .ordered import DAY_US, bucket_of, ordered_scan
from .quantiles import exact_quantiles
from .stats import prf

EV = "struct<t:bigint,side:int,off:bigint,id:bigint>"
PAIR = "struct<g_id:bigint,p_id:bigint,g_on:bigint,g_off:bigint,p_on:bigint,p_off:bigint>"


def _events(df: DataFrame, keys, side: int) -> DataFrame:
    d = ordered_scan(df.select(*keys, F.col("t_on_us").alias("t"), F.col("t_off_us").alias("off")), keys, ["t", "off"],
                     bucket_of("t", 32 * DAY_US), row_number="id")
    return d.select(*keys, "t", F.lit(side).alias("side"), "off", "id")


def _chained(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, chunk, state at its start, from chunks that say what state each possible state at their start leads to.

    `table` holds the states behind a chunk for the states `low`, low + 1, ... before it; a state is a whole number and
    0 before the first chunk of a key and behind every missing one. Tables are composed along the chunks of a
    key, so no chunk waits for its neighbour's rows.
    """
    keys = list(keys)
    per = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "low", "table"))).alias("s"))
    first = F.struct(F.lit(None).cast("bigint").alias("next"), F.lit(0).alias("state"), F.expr("cast(array() as array<struct<chunk:bigint,state:int>>)").alias("out"))

    def step(acc, c):
        state = F.when(acc["next"] == c["chunk"], acc["state"]).otherwise(0)
        return F.struct((c["chunk"] + 1).alias("next"), F.coalesce(F.get(c["table"], state - c["low"]), F.lit(0)).alias("state"),
                        F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), state.cast("int").alias("state")))).alias("out"))

    return per.select(*keys, F.explode(F.aggregate("s", first, step, lambda a: a["out"])).alias("o")).select(*keys, "o.chunk", "o.state")


def match_onsets(truth: DataFrame, pred: DataFrame, keys: Sequence[str], tau_us: int, *, chunk_us: int = DAY_US) -> DataFrame:
    """Greedy one-to-one matching in time order of onsets within `tau_us`.

    Each onset takes the earliest free partner. Walking both lists in time, the onsets that still wait are
    always the last few of one list, so what passes from one time chunk to the next is one signed number (truth
    positive). Every chunk is walked once for each number that could come in (as many as there are onsets
    within tau before its edge), the answers are composed along the chunks, and each chunk is walked
    again with the number that does come in. Output: keys, g_id, p_id, g_on, g_off, p_on, p_off.
    """
    keys = list(keys)
    width = max(int(chunk_us), int(tau_us) + 1)  # nothing waits through a whole chunk
    ev = _events(truth, keys, 0).unionByName(_events(pred, keys, 1))
    own = bucket_of("t", width)
    late = F.col("t") >= (own + 1) * width - tau_us
    placed = ev.select(*keys, F.struct("t", "side", "off", "id").alias("e"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"), own.alias("_own"))
    mine = F.col("_own") == F.col("chunk")
    held = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("e"))))
    chunks = placed.groupBy(*keys, "chunk").agg(held(mine).alias("e"), held(~mine & (F.col("e.side") == 0)).alias("g"), held(~mine & (F.col("e.side") == 1)).alias("p")).where(F.size("e") > 0)
    chunks = cut_lineage(chunks)  # onsets only
    none = F.expr(f"cast(array() as array<{EV}>)")

    def waiting(n):
        """The last n of the truths before the chunk, or the last -n of the predictions."""
        tail = lambda c, k: F.slice(F.col(c), F.size(c) - k + 1, k)
        return F.when(n > 0, tail("g", n)).when(n < 0, tail("p", -n)).otherwise(none)

    def step(acc, x):
        alive = F.filter(acc["pend"], lambda e: x["t"] - e["t"] <= tau_us)
        met = (F.size(alive) > 0) & (F.get(alive, F.lit(0))["side"] != x["side"])
        o = F.get(alive, F.lit(0))
        g0 = x["side"] == 1  # the waiting one is truth
        pick = lambda f: (F.when(g0, o[f]).otherwise(x[f]), F.when(g0, x[f]).otherwise(o[f]))
        (gi, pi), (gt, pt), (gf, pf) = pick("id"), pick("t"), pick("off")
        pair = F.struct(gi.alias("g_id"), pi.alias("p_id"), gt.alias("g_on"), gf.alias("g_off"), pt.alias("p_on"), pf.alias("p_off"))
        return F.struct(F.when(met, F.slice(alive, F.lit(2), F.greatest(F.size(alive), F.lit(1)))).otherwise(F.concat(alive, F.array(x))).alias("pend"),
                        F.when(met, F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"))

    def walk(n, out):
        return F.aggregate("e", F.struct(waiting(n).alias("pend"), F.expr(f"cast(array() as array<{PAIR}>)").alias("pairs")), step, out)

    def left(acc):
        still = F.filter(acc["pend"], lambda e: e["t"] >= (F.col("chunk") + 1) * width - tau_us)
        return F.when(F.get(still, F.lit(0))["side"] == 1, -F.size(still)).otherwise(F.size(still))

    tables = chunks.select(*keys, "chunk", (-F.size("p")).alias("low"), F.transform(F.sequence(-F.size("p"), F.size("g")), lambda n: walk(n, left)).alias("table"))
    ready = chunks.join(_chained(tables, keys), [*keys, "chunk"])
    return ready.select(*keys, F.explode(walk(F.col("state"), lambda a: a["pairs"])).alias("m")).select(*keys, "m.*")


def match_first_fit(truth: DataFrame, pred: DataFrame, keys: Sequence[str], tau_us: int, *, chunk_us: int = DAY_US) -> DataFrame:
    """Each prediction in time order takes the first unused truth (in time order) within `tau_us`.

    No prediction takes an earlier truth than the one before it did, so what passes between chunks of predictions
    is how many of the truths around the edge are behind the last one taken. Output: keys, g_id, p_id, g_on, p_on.
    """
    keys = list(keys)
    width = max(int(chunk_us), 2 * int(tau_us) + 1)
    g = _events(truth, keys, 0).select(*keys, F.struct("t", "id").alias("x"), F.explode(F.sequence(bucket_of(F.col("t") - tau_us, width), bucket_of(F.col("t") + tau_us, width))).alias("chunk"))
    p = _events(pred, keys, 1).select(*keys, F.struct("t", "id").alias("x"), bucket_of("t", width).alias("chunk"))
    listed = lambda d, n: d.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("x")).alias(n))
    chunks = cut_lineage(listed(p, "p").join(listed(g, "g"), [*keys, "chunk"]))  # predictions without any truth near match nothing
    edge = F.col("chunk") * width
    near = lambda e: F.filter("g", lambda x: (x["t"] >= e - tau_us) & (x["t"] < e + tau_us))

    def take(acc, x):
        # the first truth not passed yet that is not too early
        i = F.aggregate("g", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("i")),
                        lambda a, y: F.struct((a["n"] + 1).alias("n"), F.when((a["i"] < 0) & (a["n"] >= acc["k"]) & (y["t"] >= x["t"] - tau_us), a["n"]).otherwise(a["i"]).alias("i")), lambda a: a["i"])
        return F.transform(F.array(i), lambda j: F.when((j < 0) | (F.get("g", j)["t"] > x["t"] + tau_us), acc).otherwise(F.struct(
            (j + 1).alias("k"), F.concat(acc["m"], F.array(F.struct(F.get("g", j)["id"].alias("g_id"), x["id"].alias("p_id"), F.get("g", j)["t"].alias("g_on"), x["t"].alias("p_on")))).alias("m"))))[0]

    def walk(n, out):
        # truths of the chunk begin with those around its first edge
        return F.aggregate("p", F.struct(n.cast("int").alias("k"), F.expr("cast(array() as array<struct<g_id:bigint,p_id:bigint,g_on:bigint,p_on:bigint>>)").alias("m")), take, out)

    def passed(acc):
        """How many of the truths around the next edge are behind the last one taken."""
        return F.greatest(acc["k"] - F.size(F.filter("g", lambda x: x["t"] < edge + width - tau_us)), F.lit(0))

    tables = chunks.select(*keys, "chunk", F.lit(0).alias("low"), F.transform(F.sequence(F.lit(0), F.size(near(edge))), lambda n: walk(n, passed)).alias("table"))
    ready = chunks.join(_chained(tables, keys), [*keys, "chunk"])
    return ready.select(*keys, F.explode(walk(F.col("state"), lambda a: a["m"])).alias("m")).select(*keys, "m.*")


def greedy_pairs(cands: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """Best-first one-to-one choice among candidate pairs.

    Sequential greedy over a strict order equals repeatedly taking all pairs
    that are the best one for both ends, so it runs as rounds of two grouped
    minima. `order` columns (ascending) plus the ids break all ties.
    """
    keys = list(keys)
    cands = cut_lineage(cands)
    done = []
    rank = F.struct(*dict.fromkeys([*order, left, right]))
    while not cands.isEmpty():
        bl = cands.groupBy(*keys, left).agg(F.min(rank).alias("_r")).select(*keys, left, F.col(f"_r.{right}").alias(right))
        br = cands.groupBy(*keys, right).agg(F.min(rank).alias("_r")).select(*keys, F.col(f"_r.{left}").alias(left), right)
        m = cut_lineage(cands.join(bl, [*keys, left, right]).join(br, [*keys, left, right]))
        done.append(m)
        cands = cut_lineage(cands.join(m.select(*keys, left), [*keys, left], "left_anti").join(m.select(*keys, right), [*keys, right], "left_anti"))
    return reduce(DataFrame.unionByName, done) if done else cands


def match_best(truth: DataFrame, det: DataFrame, keys: Sequence[str], *, tol: int, ratio=(0.5, 2.0), bucket: int = DAY_US) -> DataFrame:
    """Smallest onset error first, then the earlier truth, then the earlier
    detection; the length ratio must fit. Both sides carry id, start, length
    (`start` and `tol` in any common unit)."""
    keys = list(keys)
    g = truth.select(*keys, F.col("id").alias("g_id"), F.col("start").alias("g_start"), F.col("length").alias("g_len"))
    g = g.withColumn("_a", F.col("g_start") - tol).withColumn("_z", F.col("g_start") + tol)
    d = det.select(*keys, F.col("start").alias("ts_us"), F.col("id").alias("d_id"), F.col("length").alias("d_len"))
    c = points_in(d, g, keys, start="_a", end="_z", bucket_us=bucket)
    r = F.col("g_len") / F.greatest("d_len", F.lit(1))
    c = c.where(r.between(*ratio)).select(*keys, "g_id", "d_id", F.abs(F.col("g_start") - F.col("ts_us")).alias("abs_err"), "g_start",
                                          (F.col("g_start") - F.col("ts_us")).alias("err"), (F.col("g_len") - F.col("d_len")).alias("off_err"), "g_len", "d_len")
    return greedy_pairs(c, keys, "g_id", "d_id", ["abs_err", "g_start", "d_id"])


def match_overlap(truth: DataFrame, cand: DataFrame, keys: Sequence[str], *, min_s: float = 60.0, min_frac: float = 0.3,
                  bucket_us: int = DAY_US) -> DataFrame:
    """Largest overlap first (later truth, then later candidate on ties); the
    overlap must reach min(min_s, min_frac x truth length). Sides carry id, t0_us, t1_us."""
    keys = list(keys)
    p = overlap_join(truth, cand, keys, left_span=("t0_us", "t1_us"), right_span=("t0_us", "t1_us"), bucket_us=bucket_us)
    ov = F.least("l.t1_us", "r.t1_us") - F.greatest("l.t0_us", "r.t0_us")
    need = F.least(F.lit(float(us(min_s))), min_frac * (F.col("l.t1_us") - F.col("l.t0_us")))
    c = p.where(ov >= need).select(*keys, F.col("l.id").alias("g_id"), F.col("r.id").alias("c_id"), ov.alias("ov_us"))
    c = c.withColumn("_o", -F.col("ov_us")).withColumn("_g", -F.col("g_id")).withColumn("_c", -F.col("c_id"))
    return greedy_pairs(c, keys, "g_id", "c_id", ["_o", "_g", "_c"]).drop("_o", "_g", "_c")


def in_dwell_band(lo: float = 1 / 3, hi: float = 3.0) -> Column:
    r = (F.col("p_off") - F.col("p_on")) / F.greatest(F.col("g_off") - F.col("g_on"), F.lit(1))
    return r.between(lo, hi)


def span_errors(pairs: DataFrame) -> DataFrame:
    """Signed onset / offset errors, duration ratio and IoU of matched pairs."""
    inter = F.greatest(F.lit(0), F.least("p_off", "g_off") - F.greatest("p_on", "g_on"))
    union = (F.col("p_off") - F.col("p_on")) + (F.col("g_off") - F.col("g_on")) - inter
    return pairs.select("*", ((F.col("p_on") - F.col("g_on")) / 1e6).alias("onset_err_s"), ((F.col("p_off") - F.col("g_off")) / 1e6).alias("offset_err_s"),
                        ((F.col("p_off") - F.col("p_on")) / F.greatest(F.col("g_off") - F.col("g_on"), F.lit(1))).alias("dur_ratio"),
                        (inter / F.greatest(union, F.lit(1))).alias("iou"))


def score(truth: DataFrame, pred: DataFrame, matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and precision / recall / F1 per `by`; groups may miss on any side."""
    by = list(by)
    n = lambda d, o: d.groupBy(*by).agg(F.count(F.lit(1)).alias(o))
    j = n(truth, "n_gt").join(n(pred, "n_pred"), by, "full_outer").join(n(matched, "n_matched"), by, "left").fillna(0, ["n_gt", "n_pred", "n_matched"])
    return j.select("*", *prf(F.col("n_matched"), F.col("n_pred"), F.col("n_gt")))


def span_stats(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed medians, p90 of absolute errors, median ratio and IoU of pairs."""
    e = span_errors(pairs)
    e = e.withColumn("_a", F.abs("onset_err_s")).withColumn("_b", F.abs("offset_err_s"))
    return exact_quantiles(e, by, {"onset_med_s": ("onset_err_s", 0.5), "onset_p90_abs_s": ("_a", 0.9), "offset_med_s": ("offset_err_s", 0.5),
                                   "offset_p90_abs_s": ("_b", 0.9), "dur_ratio_med": ("dur_ratio", 0.5), "iou_med": ("iou", 0.5)}, {"n_pairs": "iou"})


def cheapest_assignment(left: Column, right: Column, cost) -> Column:
    """Struct of `cost` and `chosen`: for every item of `left` the place (from 0) of its own item of `right`, at the least total cost.

    One step per item of `left`; between steps one entry is kept for each set of places in use, the cheapest,
    of equals that of the smallest places. 2**n entries instead of n! orders, for arrays of up to a dozen items, `left`
    being no longer than `right`. `cost` takes an item of each.
    """
    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("chosen"))
    places = F.sequence(F.lit(0), F.size(right) - 1)

    def step(held: Column, a: Column) -> Column:
        more = F.flatten(F.transform(held, lambda s: F.transform(
            F.filter(places, lambda j: ~F.array_contains(s["chosen"], j)),
            lambda j: F.struct((s["used"] + F.pow(F.lit(2.0), j).cast("bigint")).alias("used"), (s["cost"] + cost(a, F.get(right, j))).alias("cost"), F.concat(s["chosen"], F.array(j)).alias("chosen")))))
        return F.element_at(F.transform(F.array(more), lambda c: F.transform(F.array_distinct(F.transform(c, lambda m: m["used"])), lambda u: F.array_min(F.filter(c, lambda m: m["used"] == u)))), 1)

    best = F.aggregate(left, F.array(none), step)
    least = F.array_min(F.transform(best, lambda s: F.struct(s["cost"].alias("cost"), s["chosen"].alias("chosen"))))
    return F.when((F.size(left) > 0) & (F.size(left) <= F.size(right)), least)
