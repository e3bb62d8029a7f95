"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

Texts are cut into blocks by content: every window of `width` words picks the `anchor` words with the
smallest hash in it, and the run of windows with the same pick is a block. Equal passages give equal
blocks wherever they stand. A document is parsed against the blocks of all documents with smaller
ids: a block that is known as a whole is a factor, and neighbouring factors join. At the boundary of
a factor, where the anchor is known but the block is not (a passage begins or ends inside it), the
windows of the block are checked one by one. A word that lies in a window which starts in a document
with a smaller id is a duplicate and is removed; windows are judged on the input.

How the work is spread: the rows that are grouped are blocks (about one for 18 words), by partial
aggregation, so that a passage that stands in a third of all documents is one row per task before
the shuffle. Only windows of boundary blocks are compared singly, and of equal boundary blocks only
those of the smallest document. Texts are shuffled twice by their own key, compressed, and never collected.
Blocks and windows are compared by two 64-bit hashes (of the anchor and of the block or window).

Defined results: null and empty texts have no words; a text of fewer than `width` words keeps all.
A row with a null id neither removes words elsewhere nor loses any. Rows with equal ids do not remove
each other's words; each row is treated by its own text. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import packed, slices, unpack

WIDTH, ANCHOR = 50, 15
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = "array<struct<a:int,b:int>>"


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  grows once per worker
    if len(held.get(base, ())) < n:
        held[base] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 4096) - 1, base, np.uint64))))
    return held[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of any stretch of one text's words."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n))))
        self.back = _powers(_INVERSE, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a])


def blocks(words: list[bytes], known: _Hashes, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashed] | None:
    """Anchor hash, block hash, first window and number of windows of every block of a text."""
    n = len(words)
    if n < width:
        return None
    hashed = Hashed(np.fromiter(map(known.__getitem__, words), np.uint64, n))
    at = np.arange(n - anchor + 1)
    grams = hashed.of(at, at + anchor)
    picks = np.lib.stride_tricks.sliding_window_view(grams, width - anchor + 1).argmin(axis=1) + np.arange(n - width + 1)
    first = np.flatnonzero(np.concatenate(([True], picks[1:] != picks[:-1])))
    many = np.diff(np.append(first, n - width + 1))
    return grams[picks[first]], hashed.of(first, first + many - 1 + width), first, many, hashed


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _block_task(width: int, anchor: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches):
            parts = []
            for i, (doc, key, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc", "key", "text")])):
                found = blocks(text.encode("utf-8", "surrogatepass").split(), known, width, anchor)
                if found:
                    a, b, first, many, _ = found
                    parts.append((_signed(a), _signed(b), np.full(len(a), doc), np.full(len(a), key), first.astype(np.int32), many.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["anchor", "block", "doc", "key", "first", "many"])

    return task, "anchor long, block long, doc long, key long, first int, many int"


def _windows_task(width: int, anchor: int):
    """Window hashes of the boundary blocks listed with each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches, packs=True):
            parts = []
            for doc, key, text, ask in zip(*[batch.column(c).to_pylist() for c in ("doc", "key", "text", "ask")]):
                a, _, first, many, hashed = blocks(unpack(text).split(), known, width, anchor)
                mine = np.isin(first, np.array(ask))
                a, first, many = a[mine], first[mine], many[mine]
                at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                parts.append((np.repeat(_signed(a), many), _signed(hashed.of(at, at + width)), np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["anchor", "window", "doc", "key", "at"])

    return task, "anchor long, window long, doc long, key long, at int"


def merged_spans(starts: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Word spans covered by runs of duplicate windows (first, past the last), in order and disjoint."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b - 1 + width))
        else:
            out.append((a, b - 1 + width))
    return out


def duplicate_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc, key (hash of the text) and `runs` of duplicate windows (first, past the last) of every row that has any."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    task, schema = _block_task(width, anchor)
    found = texts.mapInArrow(task, schema)

    # anchors of at least two documents; all else is unique
    shared = cut_lineage(found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("anchor"))
    known = cut_lineage(found.join(shared, "anchor"))

    # whole blocks: the smallest document holds the reference block
    held = known.groupBy("anchor", "block").agg(F.min("doc").alias("lo"))
    several = held.groupBy("anchor").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).filter("b0 < b1").select("anchor", F.lit(True).alias("edge"))
    held = cut_lineage(held.join(several, "anchor", "left"))
    parsed = known.join(held, ["anchor", "block"])
    factors = parsed.filter("doc > lo").select("doc", "key", "first", "many")

    # boundary blocks: their windows, of the smallest document that has the block
    ask = parsed.filter("doc = lo AND edge").groupBy("doc", "key").agg(F.collect_set("first").alias("ask"))
    task, schema = _windows_task(width, anchor)
    windows = cut_lineage(packed(texts).join(ask, ["doc", "key"]).mapInArrow(task, schema))
    lowest = windows.groupBy("anchor", "window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("anchor", "window", "lo")
    single = windows.join(lowest, ["anchor", "window"]).filter("doc > lo").select("doc", "key", F.col("at").alias("first"), F.lit(1).alias("many"))
    runs = F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("many")).alias("b")))
    return factors.unionByName(single).groupBy("doc", "key").agg(runs.alias("runs"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """The columns of `keep` with n_words, spans (removed words, half-open) and kept (the words left, blank between)."""
    runs = duplicate_windows(docs, doc_id, text, width, anchor)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    rows = packed(rows).join(runs, ["doc", "key"], "left").select(*names, "text", "runs")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, packs=True):
            n, spans, kept = [], [], []
            for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = unpack(t).split() if t else []
                cut = merged_spans([(x["a"], x["b"]) for x in r or ()], width)
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in cut])
                for a, b in reversed(cut):
                    del words[a:b]
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "spans", "kept"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], f"n_words long, spans {_SPAN}, kept string"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "spans", "kept")
