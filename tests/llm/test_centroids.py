"""Clustering over zone maps against plain rounds over all pairs, and its defined results on odd input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from meterloom.llm import centroids


def plain(rows, k, rounds, width, seed=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    packed = lambda v: np.array(v, np.int32).tobytes()
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))
    mids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(mids)) for _, v in kept]

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for (_, v), (_, c) in zip(kept, assign()):
            held[c].append(v)
        for c, listed in held.items():
            mids[c] = [sum(x) // len(listed) for x in zip(*listed)]
    last = assign()
    per = collections.Counter()
    for d, c in last:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mids]
    return sorted(((i is None, i or 0), c, d, per[c], sum(per.values()), sha[c]) for (i, _), (d, c) in zip(kept, last))


def taken(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def table_of(spark, rows, kind="double", parts=4):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, id string, v int").repartition(parts)


def odd_rows(width, n=400, seed=1):
    rnd = random.Random(seed)
    spots = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(spots)]) for i in range(n)]
    same = [0.25] * width
    rows += [(1000 + i, same) for i in range(n // 2)]  # a third of all rows
    rows += [(2000, None), (2001, [0.0] * (width - 1)), (2002, [0.0] * (width + 1)), (2003, [None] + [0.0] * (width - 1)), (2004, [float("nan")] * width), (2005, [float("-inf")] + [0.0] * (width - 1)), (2006, []), (None, spots[0]), (5, spots[1]), (5, rows[5][1]), (2007, [-1 / 256] * width)]
    return rows


@pytest.mark.parametrize("width,k,block", [(3, 7, 8), (8, 40, 32)])
def test_equals_plain_rounds(spark, width, k, block):
    rows = odd_rows(width)
    got = centroids.cluster(table_of(spark, rows), k, 5, width=width, block=block)
    assert taken(got) == plain(rows, k, 5, width)


def test_ties_repeats_few_and_no_rows(spark):
    grid = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(itertools.product(range(-3, 4), repeat=2))]
    rows = grid + grid + [(100 + i, [0.0, 0.0]) for i in range(50)]
    assert taken(centroids.cluster(table_of(spark, rows), 9, 3, width=2, scale=1, block=4)) == plain(rows, 9, 3, 2, scale=1)
    few = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 1.0])]
    assert taken(centroids.cluster(table_of(spark, few), 40, 5, width=2)) == plain(few, 40, 5, 2)
    assert centroids.cluster(table_of(spark, few), 40, 5, width=3).count() == 0
    assert centroids.cluster(table_of(spark, few).limit(0), 4, 1, width=2).count() == 0


def test_large_components_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-5e5, 5e5) for _ in range(4)]) for i in range(60)]
    assert taken(centroids.cluster(table_of(spark, rows), 5, 4, width=4)) == plain(rows, 5, 4, 4)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(table_of(spark, [(1, [1e6] * 4)]), 5, 1, width=4).count()


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 2), (2, 3), (3, 2), (5, 2), (4, 1)])
def test_curve_visits_neighbouring_cells(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint8)
    keys = [bytes(k) for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    order = cells[sorted(range(len(cells)), key=keys.__getitem__)].astype(int)
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_no_nearest_centroid_is_pruned():
    rnd = np.random.default_rng(3)
    pruned = 0
    for _ in range(200):
        middle = rnd.integers(-300, 300, 6)
        v = (middle + rnd.integers(-20, 21, (30, 6))).astype(np.int32)
        c = rnd.integers(-300, 300, (12, 6))
        near = centroids.candidates(v.min(axis=0).astype(np.int64), v.max(axis=0).astype(np.int64), c)
        best, away = centroids.nearest(v, c)
        some, least = centroids.nearest(v, c[near])
        assert (near[some] == best).all() and (away == least).all()
        pruned += 12 - len(near)
    assert pruned > 1000
