"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items.

Texts and items are lower-cased (A-Z) and cut into words of digits, letters and everything beyond
ASCII. Each window of `width` consecutive item words is a test string; an item with fewer words is
one window. Test strings of one length share a search table: `shift` says for a block of two words
how far the scan may jump because no test string can end sooner, and blocks with shift 0 lead to
the bucket of the test strings that end in that block, which are compared word by word.

The tables hold one part of the benchmark at a time: a benchmark of more than `part_words` words is
cut into parts, each is searched in its own pass, and the hits of a text are united. With one part
(the usual case) texts are never shuffled.

Defined results: null and empty texts have no words and no hits; items without words never occur.
An item whose id is null hits words but is not counted or listed. Items with equal ids count once.
Repeated document rows repeat their result. An empty benchmark leaves every text clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import apart, slices

WIDTH = 10
PART_WORDS = 2_000_000
#: Byte by byte: A-Z to lower case, other ASCII that is neither digit nor letter to a blank.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Search tables for word sequences of one length."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[int]]):
        self.length = len(next(iter(strings)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = {}
        for s, items in strings.items():
            for end in range(self.block, self.length + 1):
                block, left = s[end - self.block:end], self.length - end
                if left < self.shift.get(block, self.far):
                    self.shift[block] = left
            self.buckets.setdefault(s[-self.block:], []).append((s, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position of the first word, items) of every occurrence."""
        length, block, far, shift, n = self.length, self.block, self.far, self.shift, len(words)
        at = length
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            step = shift.get(key, far)
            if step:
                at += step
                continue
            for s, items in self.buckets[key]:
                if words[at - length] == s[0] and tuple(words[at - length:at]) == s:
                    yield at - length, items
            at += 1


def tables(items: list[list[bytes]], width: int) -> list[WuManber]:
    by: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, words in enumerate(items):
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            held = by.setdefault(n, {}).setdefault(tuple(words[i:i + n]), [])
            if not held or held[-1] != k:
                held.append(k)
    return [WuManber(x) for x in by.values()]


def search(words: list[bytes], found_by: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint half-open spans of hit words in order, and the items that occur."""
    raw, items = [], set()
    for table in found_by:
        for at, which in table.find(words):
            raw.append((at, at + table.length))
            items.update(which)
    return merge(raw), items


def merge(raw: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(raw):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark in parts of at most `part_words` words, or one item if that is longer."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    part, size = [], 0
    for x in rows.toLocalIterator():
        words = words_of(x.text)
        if part and size + len(words) > part_words:
            yield part
            part, size = [], 0
        part.append((x.item, words))
        size += len(words)
    if part:
        yield part


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, part_words: int = PART_WORDS) -> DataFrame:
    """The columns of `keep` with n_words, spans (hit words, half-open) and items (sorted ids) for every row."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("text"))
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*kinds, "n_words long, spans array<struct<a:int,b:int>>, items array<string>"])
    spark = docs.sparkSession

    def one(part: list[tuple[str | None, list[bytes]]]):
        sent = spark.sparkContext.broadcast(part)  # part_words words at most

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, found_by = [x[0] for x in sent.value], tables([x[1] for x in sent.value], width)
            for batch in slices(batches):
                n, spans, items = [], [], []
                for t in batch.column("text").to_pylist():
                    words = words_of(t)
                    hit, which = search(words, found_by)
                    n.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in hit])
                    items.append(sorted({ids[k] for k in which if ids[k] is not None}))
                kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

        return task

    parts = [one(p) for p in _parts(benchmark, item_id, item_text, part_words)] or [one([])]
    if len(parts) == 1:
        out = rows.mapInArrow(parts[0], schema)
    else:
        out = _united(rows, parts, names, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "spans", "items")


def _united(rows: DataFrame, parts: list, names: list[str], schema: str) -> DataFrame:
    """Pass the rows through every part in turn; each pass adds its spans and items to what came with the row."""

    def merged(a, b):
        return F.array_sort(F.concat(a, b))

    first = True
    for task in parts:
        if first:
            out, first = _with_text(rows, task, names, schema), False
            continue
        more = _with_text(out.select(*names, "text", "n_words", F.col("spans").alias("s0"), F.col("items").alias("i0")), task, names, schema, ("s0", "i0"))
        out = more.select(*names, "text", "n_words", merged("spans", "s0").alias("spans"), F.array_sort(F.array_union("items", "i0")).alias("items"))
    return out.select(*names, "n_words", _join_spans("spans").alias("spans"), "items")


def _with_text(rows: DataFrame, task, names: list[str], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    kinds = ", ".join(["text string", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def watch():
            for b in slices(batches):
                held.append(b)
                yield b

        for out in task(watch()):
            b = held.pop(0)
            cols = ["text", *more]
            yield pa.RecordBatch.from_arrays([*out.columns, *[b.column(c) for c in cols]], [*out.schema.names, *cols])

    return rows.mapInArrow(both, f"{schema}, {kinds}")


def _join_spans(col: str):
    """Sorted spans united where they meet."""
    kind = "array<struct<a:int,b:int>>"
    return F.aggregate(F.col(col), F.lit(None).cast(kind), lambda acc, x: F.when(acc.isNull(), F.array(x)).when(
        F.element_at(acc, -1)["b"] >= x["a"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))), lambda acc: F.coalesce(acc, F.array().cast(kind)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of documents in which no test string occurs."""
    own, names, text = apart(docs)
    found = find_items(own, benchmark, text, names, width=width, part_words=part_words)
    return found.filter(F.size("spans") == 0).select(*names).toDF(*docs.columns)

