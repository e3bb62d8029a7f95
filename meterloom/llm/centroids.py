"""Centroid clustering (Lloyd's rounds) over zone maps in Hilbert order.

Vectors become integers, are put in the order of a Hilbert curve through all their dimensions, and are
stored in blocks of `BLOCK` neighbours with the smallest and largest value of every dimension, the zone
map. A round looks at each block's box first: no vector of it is nearer to a centroid than the box is,
nor farther than the box's farthest corner. Centroids whose least distance exceeds the smallest of
the greatest ones cannot be nearest to any vector of the block; the others are compared exactly, all
vectors at once. All arithmetic is exact, so blocks and their order change nothing in the results.

The curve's grid has four cells a dimension, cut at its mean and one standard deviation to both sides.
Vectors are dealt by ranges of (curve position, salt), so that a vector that occurs very often is spread
over several ranges. Each task of a round sends one row of sums for every centroid; the driver holds the
centroids only. The blocks are a table in the shared folder, written once and read in every round.

Defined results: rows whose vector is null, has another number of components, or a component that is
null or not finite are left out. Starts are the k kept rows with the smallest SHA-256 of "seed:id" (a
null id counts as the empty text; equal ids are ordered by their vectors); with fewer than k rows each is
a start. Equal distances go to the smaller number, centroids without vectors stay as they are. Repeated
rows count, and come out, as often as they occur. Tables without a kept vector give no rows. Components that
exceed 2**27 after scaling raise an error, since distances might not fit into 64 bits. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

BLOCK = 256
MOST, EXACT = 1 << 27, 1 << 22  # largest component; up to EXACT, products and their sums are whole numbers in doubles
CELLS = 2  # bits of the grid, for each dimension


def kept_vectors(rows: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """id and v, the scaled components as packed 32-bit integers, of all rows with a whole vector."""
    own = rows.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = own.filter((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * float(scale))
            if np.abs(v).max(initial=0) > MOST:
                raise ValueError(f"a vector has components beyond {MOST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(v.astype(np.int32))], ["id", "v"])

    return whole.mapInArrow(task, f"id {own.schema['id'].dataType.simpleString()}, v binary")


def _packed(v: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(v)], pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve position of every row of grid cells (numbers below 2**bits), as rows of bytes in ascending order."""
    x = cells.astype(np.uint8).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # turn and mirror the smaller cubes back
        low = np.uint8((1 << b) - 1)
        for i in range(dims):
            there = (x[i] >> b & 1).astype(bool)
            swap = np.where(there, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(there, low, swap).astype(np.uint8)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code over the dimensions
    turn = np.zeros(x.shape[1], np.uint8)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0).astype(np.uint8)
    x ^= turn
    planes = np.stack([x >> b & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(planes.reshape(bits * dims, -1), axis=0).T


def write_blocks(vectors: DataFrame, path: str, width: int, block: int = BLOCK) -> None:
    """Kept vectors as a table of blocks: ids, v, lo, hi; blocks are runs of the Hilbert order."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            v = _matrix(batch.column("v"), width).astype(float)
            n, s, q = n + len(v), s + v.sum(axis=0), q + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([float(n)] * width), pa.array(s), pa.array(q)], ["d", "n", "s", "q"])

    rows = vectors.select("v").mapInArrow(moments, "d int, n double, s double, q double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("d").collect()
    n = max(rows[0][1], 1.0) if rows else 1.0
    mean = np.array([r[2] for r in rows]) / n
    wide = np.sqrt(np.maximum(np.array([r[3] for r in rows]) / n - mean * mean, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            cells = (v >= mean - wide).astype(np.uint8) + (v >= mean) + (v >= mean + wide)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), _packed(hilbert_keys(cells, CELLS))], ["id", "v", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            end = len(whole) if last else len(whole) // block * block
            held[:] = whole.slice(end).to_batches()
            v = _matrix(whole.column("v").slice(0, end), width)
            starts = list(range(0, end, block))
            parts = [v[a:a + block] for a in starts]
            ids = whole.column("id").slice(0, end).combine_chunks()
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([*starts, end], pa.int32()), ids if isinstance(ids, pa.Array) else ids.chunk(0)),
                pa.array([p.tobytes() for p in parts], pa.binary()),
                pa.array([p.min(axis=0).tobytes() for p in parts], pa.binary()),
                pa.array([p.max(axis=0).tobytes() for p in parts], pa.binary())], ["ids", "v", "lo", "hi"])

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= 16 * block:
                yield blocks(False)
        if sum(map(len, held)):
            yield blocks(True)

    kind = vectors.schema["id"].dataType.simpleString()
    ordered = vectors.mapInArrow(placed, f"id {kind}, v binary, key binary").withColumn("salt", F.xxhash64("id", "v"))
    ordered = ordered.repartitionByRange("key", "salt").sortWithinPartitions("key").select("id", "v")
    ordered.mapInArrow(cut, f"ids array<{kind}>, v binary, lo binary, hi binary").write.parquet(path)


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box, ascending."""
    below, above = lo - centroids, centroids - hi
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(-below, -above) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid (the first among equals) and the squared distance of every vector, exactly."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(float), centroids.astype(float)
        away = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        away = np.stack([((v.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(v)), best].astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    width = centroids.shape[1]
    for batch in batches:
        for i, (v, lo, hi) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("v", "lo", "hi")])):
            v = np.frombuffer(v, np.int32).reshape(-1, width)
            near = candidates(np.frombuffer(lo, np.int32).astype(np.int64), np.frombuffer(hi, np.int32).astype(np.int64), centroids)
            best, away = nearest(v, centroids[near])
            yield batch, i, v, near[best], away


def _sums(centroids: np.ndarray):
    k, width = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, _, v, cluster, _ in _assigned(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            ids, start = np.unique(cluster[order], return_index=True)
            total[ids] += np.add.reduceat(v[order].astype(np.int64), start, axis=0)
            number += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(number[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return task


def _rows(centroids: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, cluster, away in _assigned(batches, centroids):
            ids = batch.column("ids").slice(i, 1).flatten()
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], ["id", "cluster", "distance"])

    return task


def starts(vectors: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The first centroids; k rows at most reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], np.int32) for r in rows], np.int64).reshape(-1, width)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = rows.sparkSession
    vectors = kept_vectors(rows, vec_id, vector, width, scale)
    path = scratch_path(spark, "blocks")
    write_blocks(vectors, path, width, block)
    centroids = starts(vectors, k, seed, width)
    boxed = spark.read.parquet(path)
    for _ in range(rounds if len(centroids) else 0):
        sums = boxed.select("v", "lo", "hi").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        each = sums.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        centroids = centroids.copy()
        for r in each.collect():  # k x width rows at most
            centroids[r["cluster"], r["d"]] = r["s"] // r["n"]
    kind = vectors.schema["id"].dataType.simpleString()
    out = cut_lineage(boxed.mapInArrow(_rows(centroids), f"id {kind}, cluster int, distance long"))
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    named = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
