"""Differences stay exact where no table can be peeled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meterloom.llm import fingerprint


@pytest.mark.parametrize("sizes", [(), fingerprint.SIZES])
def test_differences_without_and_with_tables(spark, monkeypatch, sizes):
    monkeypatch.setattr(fingerprint, "SIZES", sizes)
    rnd = random.Random(3)
    rows = []
    for i in range(12):
        common = [rnd.getrandbits(62) for _ in range(rnd.randint(0, 300))]
        own = lambda: [rnd.getrandbits(62) for _ in range(rnd.choice([0, 3, 200]))]
        rows.append((i, common + own(), common + own()))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>").repartition(3)
    for r in df.select("i", fingerprint.retried(F.col("a"), F.col("b")).alias("d")).collect():
        _, a, b = rows[r.i]
        assert sorted((x.k, x.s) for x in r.d) == sorted([(k, 1) for k in set(a) - set(b)] + [(k, -1) for k in set(b) - set(a)])
