"""Texts are compressed for shuffles, and batches of them are cut by their size once unpacked."""

import random

import numpy as np
import pyarrow as pa

from meterloom.llm import neardup, rows, substring


def test_packed_texts(spark):
    texts = [None, "", "é\x00 word", "the same words again " * 4000, "\n".join(f"line {i} of a text" for i in range(500))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in rows.packed(table).collect()}
    assert [got[i] and rows.unpack(bytes(got[i])).decode() for i in range(5)] == texts and got[0] is None
    assert sum(len(x) for x in got.values() if x) < 0.3 * sum(len(x) for x in texts if x)


def test_slices_of_packed_texts():
    made = [rows.pack(b"a " * (1 << 19))] * 8 + [None]  # a megabyte each, a few bytes packed
    batch = pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["text"])
    assert [len(b) for b in rows.slices(iter([batch]), packs=True)] == [3, 3, 3]
    assert [len(b) for b in rows.slices(iter([batch]))] == [9]


def test_whole_texts_travel_packed(spark):
    docs = spark.createDataFrame([(i, "w " * 60) for i in range(4)], "doc_id long, text string")
    plan = substring.remove_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" in plan and plan.count("mapInArrow") + plan.count("MapInArrow") >= 2


def test_shares_bound_the_bag_distance():
    rnd = np.random.default_rng(4)
    for n in (1, 12, 300):
        a, b = rnd.integers(0, 1 << 32, n, dtype=np.uint32), rnd.integers(0, 1 << 32, n + 2, dtype=np.uint32)
        b[:n // 2] = a[:n // 2]
        away = neardup.bag_distance(*[np.unique(x, return_counts=True) for x in (a, b)])
        assert sum(abs(x - y) for x, y in zip(neardup.shares(a), neardup.shares(b))) <= away


def test_strangers_in_a_bucket_are_not_compared(spark, monkeypatch):
    """Texts that begin alike share keys without being similar: few of their pairs may be written or aligned."""
    rnd, cut, kept = random.Random(8), neardup.cut_lineage, []

    def counted(df):
        out = cut(df)
        kept.append(out.count() if {"ca", "cb"} <= set(out.columns) or {"a", "b", "link"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(neardup, "cut_lineage", counted)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[f"s{i}" for i in range(10)] + [rnd.choice(vocabulary) for _ in range(20)] for _ in range(120)]
    near = [t[:28] + ["x", "y"] for t in texts[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + near)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.groups(docs).collect()}
    assert got == {i: i - 120 if i >= 120 else i for i in range(130)}
    assert max(kept) < 1000  # all pairs: 8,385
