"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A text's paragraphs (pieces between line ends, empty ones aside, equal ones once) are hashed to
64-bit digests. A sketch has three sub-tables; every digest goes into one cell of each, and a cell
holds how many digests it has, their XOR and the XOR of their check hashes. Sketches of two versions
are subtracted cell by cell: common paragraphs cancel. Cells that hold a single digest are peeled:
the digest is known, is taken out of its other cells, and frees further cells. If peeling stalls, the
sketch was too small for the difference; then the digests are split into shards of about `SHARD` and
each shard is retried with 24, 48, ... cells and other hash functions. A shard that fails at the
largest size (about one in 10**8) counts as wholly different.

The fingerprint is the smallest sketch (12 cells) in hex; likeness is the Jaccard similarity of the
paragraph sets that the recovered digests imply.

Defined results: a null text is an empty one; texts without paragraphs are alike among themselves (1)
and unlike all others (0). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, SIZES, SHARD, ROUNDS = 4, (8, 16, 32, 64, 128, 256), 16, 16
_DIFF = "array<struct<k:bigint,s:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(77))


def _xor(items: Column, name: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(p[name]))


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _item(k: Column, sign: Column, q: int, turn: int) -> Column:
    """A digest with its sign, check hash and its cell in each of three sub-tables of q cells."""
    mask = F.lit(q - 1).cast("long")
    return _let(F.xxhash64(k, F.lit(turn)), lambda g: F.struct(
        k.alias("k"), sign.cast("int").alias("s"), _check(k).alias("h"), g.bitwiseAND(mask).cast("int").alias("c0"),
        (F.shiftrightunsigned(g, 20).bitwiseAND(mask) + q).cast("int").alias("c1"), (F.shiftrightunsigned(g, 40).bitwiseAND(mask) + 2 * q).cast("int").alias("c2")))


def _in_cell(p: Column, j: Column) -> Column:
    return (p["c0"] == j) | (p["c1"] == j) | (p["c2"] == j)


def _table(items: Column, q: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3 * q - 1)), lambda j: _let(F.filter(items, lambda p: _in_cell(p, j)), lambda mine: F.struct(
        F.aggregate(mine, F.lit(0), lambda a, p: a + p["s"]).alias("c"), _xor(mine, "k").alias("k"), _xor(mine, "h").alias("h"))))


def sketch(digest: Column, q: int = BASE, turn: int = 0) -> Column:
    """The sketch of a set of digests: 3 q cells of (count, XOR of digests, XOR of check hashes)."""
    return _let(F.transform(digest, lambda d: _item(d, F.lit(1), q, turn)), lambda items: _table(items, q))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, q: int, turn: int = 0) -> Column:
    """(digest, sign) of every difference, null if peeling stalls before the table is empty."""

    def pure(table: Column) -> Column:
        single = F.filter(table, lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        return F.array_distinct(F.transform(single, lambda x: _item(x["k"], x["c"], q, turn)))

    def without(table: Column, found: Column) -> Column:
        return F.transform(table, lambda x, j: _let(F.filter(found, lambda p: _in_cell(p, j)), lambda hit: F.when(F.size(hit) == 0, x).otherwise(F.struct(
            (x["c"] - F.aggregate(hit, F.lit(0), lambda a, p: a + p["s"])).alias("c"), x["k"].bitwiseXOR(_xor(hit, "k")).alias("k"), x["h"].bitwiseXOR(_xor(hit, "h")).alias("h")))))

    def turn_of(state: Column) -> Column:
        return F.when(state["done"], state).otherwise(_let(pure(state["cells"]), lambda found: F.when(F.size(found) == 0, F.struct(state["cells"].alias("cells"), state["out"].alias("out"), F.lit(True).alias("done"))).otherwise(F.struct(
            without(state["cells"], found).alias("cells"), F.concat(state["out"], F.transform(found, lambda p: F.struct(p["k"].alias("k"), p["s"].alias("s")))).alias("out"), F.lit(False).alias("done")))))

    start = F.struct(cells.alias("cells"), F.array().cast(_DIFF).alias("out"), F.lit(False).alias("done"))
    empty = lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: turn_of(state), lambda state: F.when(F.forall(state["cells"], empty), state["out"]))


def _signed(a: Column, b: Column, q: int, turn: int) -> Column:
    return F.concat(F.transform(a, lambda d: _item(d, F.lit(1), q, turn)), F.transform(b, lambda d: _item(d, F.lit(-1), q, turn)))


def _attempt(a: Column, b: Column, q: int, turn: int) -> Column:
    return _let(_signed(a, b, q, turn), lambda items: peel(_table(items, q), q, turn))


def retried(a: Column, b: Column) -> Column:
    """Differences of two digest sets, shard by shard, each with tables that grow until peeling ends."""

    def part(d: Column, shard: Column, shards: Column) -> Column:
        return F.filter(d, lambda x: x.bitwiseAND(shards - 1) == shard)

    def one(x: Column, y: Column) -> Column:
        tries = [_attempt(x, y, q, turn) for turn, q in enumerate(SIZES, 1)]
        signed = lambda d, s: F.transform(d, lambda k: F.struct(k.alias("k"), F.lit(s).alias("s")))
        exact = F.concat(signed(F.array_except(x, y), 1), signed(F.array_except(y, x), -1))  # should even the largest table stall
        return F.coalesce(*tries, exact)

    count = F.size(a) + F.size(b)
    shards = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(count, F.lit(1)) / F.lit(float(SHARD)))))).cast("long")
    return _let(shards, lambda n: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda s: _let(F.struct(part(a, s, n).alias("x"), part(b, s, n).alias("y")), lambda p: one(p["x"], p["y"])))))


def differences(sketch_a: Column, sketch_b: Column, a: Column, b: Column) -> Column:
    """(digest, sign) of the paragraphs that only one version has: +1 the first's, -1 the second's."""
    return F.coalesce(peel(subtract(sketch_a, sketch_b), BASE), retried(a, b))


def likeness(diff: Column, n_a: Column, n_b: Column) -> Column:
    """Jaccard similarity of two paragraph sets of n_a and n_b, from their differences."""
    return _let(F.aggregate(diff, F.lit(0), lambda n, x: n + F.when(x["s"] == 1, 1).otherwise(0)), lambda only: F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a - only) / (n_a + F.size(diff) - only)).cast("double"))


def text_of(cells: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws("-", F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"]))), ".")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_rows: int = 4096) -> tuple[DataFrame, Window]:
    """id, text, part, extra of every row, and the window in which the next row by descending id follows.

    Ids are dealt into chunks of about `chunk_rows` by their quantiles, so that no task orders the
    whole table; each chunk gets a copy (`extra`) of the row that follows its last one, and the last
    chunk one of the very first. Rows with equal ids follow in the order of the text's hash, null ids
    come last.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    steps = [i / 256 for i in range(1, 256)]
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("id", steps, 10_000)).first()
    bounds = sorted(set(cuts or []))
    fine = max(1, n // (256 * chunk_rows))
    place = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.coalesce("id", F.lit(-(1 << 63)))))
    if fine > 1 and len(bounds) > 1:  # chunks between two neighbouring quantiles, by equal widths
        edges = F.array(*map(F.lit, [bounds[0], *bounds, bounds[-1]]))
        lo, hi = F.element_at(edges, F.col("place") + 1), F.element_at(edges, F.col("place") + 2)
        share = F.when(hi > lo, F.floor((F.col("id") - lo).cast("double") / (hi - lo).cast("double") * fine)).otherwise(F.lit(0))
        part = F.col("place") * fine + F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.coalesce(share, F.lit(0))))
    else:
        part = F.col("place")
    rows = rows.withColumn("place", place).withColumn("part", part.cast("long")).drop("place").withColumn("h", F.xxhash64("text"))
    # the first row of each chunk, for the chunk before it
    heads = rows.groupBy("part").agg(F.max(F.struct("id", "h")).alias("head"))
    order = Window.orderBy(F.desc("part"))  # one small row per chunk
    heads = heads.select(F.col("part"), F.col("head.id").alias("id"), F.col("head.h").alias("h"), F.lag("part").over(order).alias("to"), F.min("part").over(Window.partitionBy()).alias("last"))
    heads = heads.select("part", "id", "h", F.coalesce("to", "last").alias("to"))
    if 256 * fine <= 65_536:
        heads = F.broadcast(heads)  # 256 * fine rows of 32 bytes
    extra = rows.alias("r").join(heads.alias("t"), (F.col("r.part") == F.col("t.part")) & F.col("r.id").eqNullSafe(F.col("t.id")) & (F.col("r.h") == F.col("t.h")))
    extra = extra.select("r.id", "r.text", F.col("t.to").alias("part"), "r.h").dropDuplicates(["part", "id", "h"])
    both = rows.select("id", "text", "part", "h", F.lit(False).alias("extra")).union(extra.select("id", "text", "part", "h", F.lit(True).alias("extra")))
    return both, Window.partitionBy("part").orderBy("extra", F.desc_nulls_last("id"), F.desc("h"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and the likeness to the edited and the next text."""
    rows, order = with_next(docs, doc_id, text)
    rows = rows.withColumn("follow", F.coalesce(F.lead("text").over(order), "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("follow").substr(F.lit(1), half))).drop("follow")
    rows = rows.withColumn("d", digests(F.col("text"))).withColumn("t", sketch(F.col("d")))
    rows = rows.withColumn("dn", F.coalesce(F.lead("d").over(order), "d")).withColumn("tn", F.coalesce(F.lead("t").over(order), "t")).filter(~F.col("extra"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).withColumn("de", digests(F.col("edited"))).withColumn("te", sketch(F.col("de")))
    rows = rows.withColumn("xe", differences(F.col("t"), F.col("te"), F.col("d"), F.col("de"))).withColumn("xn", differences(F.col("t"), F.col("tn"), F.col("d"), F.col("dn")))
    return rows.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", text_of(F.col("t")).alias("fingerprint"), text_of(F.col("te")).alias("edited_fingerprint"),
                       likeness(F.col("xe"), F.size("d"), F.size("de")).alias("near_edited"), likeness(F.col("xn"), F.size("d"), F.size("dn")).alias("near_next"))
