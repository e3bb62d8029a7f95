"""Byte-level BPE encoding and decoding by a rank file.

A text is cut by the tokenizer's pattern; every match is encoded on its own: its bytes are the first
pieces, and the neighbouring pair whose joint bytes have the lowest rank is merged, leftmost first,
until no pair has a rank. A match that has a rank as a whole is one token. Decoding joins the bytes of
the ids.

`encode_words` folds the merges of distinct matches by Spark's higher-order functions over arrays of
byte strings; the ranks are a literal: `BUCKETS` maps, picked by the crc32 of the bytes, since a look-up
in a Spark map walks its entries. To join a table of distinct matches with all their occurrences moves
several times the input, so `encode` merges inside tasks, each with a bounded memory of the words it has
met: the same rank map and the same merges, no shuffle.

Defined results: null and empty texts have no tokens, and decode to no bytes. Bytes without a rank
(a vocabulary without all single bytes) are an error of the vocabulary and raise. Repeated rows repeat
their result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from binascii import crc32
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import slices

BUCKETS = 2048
#: White space other than single blanks and line ends between words.
_UNEVEN = re.compile(r"\s\s|[^\S \n]").search


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line holds the base64 of a token's bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<binary,int>>, folded to one literal by the optimizer."""
    held: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        held[crc32(piece) % BUCKETS].append({"k": base64.b64encode(piece).decode(), "v": rank})
    return F.array(*[F.map_from_entries(F.from_json(F.lit(json.dumps(x)), "array<struct<k:binary,v:int>>")) for x in held])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(maps: Column, piece: Column) -> Column:
    return F.element_at(maps, (F.crc32(piece) % BUCKETS + 1).cast("int"))[piece]


def matches(text: Column, pattern: str) -> Column:
    """All matches of the tokenizer's pattern, in order; white space as Unicode has it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def fold_merges(word: Column, maps: Column) -> Column:
    """Token ids of one match, given as binary."""

    def merge(s: Column, i: Column) -> Column:
        p, r = s["p"], s["r"]
        last = F.size(p)
        joint = F.concat(F.element_at(p, i), F.element_at(p, i + 1))
        return _let(F.struct(joint.alias("j"), i.alias("i")), lambda x: F.struct(
            F.concat(F.slice(p, 1, x["i"] - 1), F.array(x["j"]), F.slice(p, x["i"] + 2, last)).alias("p"),
            F.concat(
                F.slice(r, 1, F.greatest(x["i"] - 2, F.lit(0))),
                F.when(x["i"] > 1, F.array(_rank(maps, F.concat(F.element_at(p, F.greatest(x["i"] - 1, F.lit(1))), x["j"])))).otherwise(F.array().cast("array<int>")),
                F.when(x["i"] + 1 < last, F.array(_rank(maps, F.concat(x["j"], F.element_at(p, F.least(x["i"] + 2, last)))))).otherwise(F.array().cast("array<int>")),
                F.slice(r, x["i"] + 2, last)).alias("r")))

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s["r"]), lambda low: F.when(low.isNull(), s).otherwise(_let(F.array_position(s["r"], low).cast("int"), lambda i: merge(s, i))))

    n = F.octet_length(word)
    first = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: _rank(maps, F.concat(F.element_at(p, i), F.element_at(p, i + 1))))
    folded = _let(first, lambda p: F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(p.alias("p"), pairs(p).alias("r")), step, lambda s: F.transform(s["p"], lambda x: _rank(maps, x))))
    return _let(_rank(maps, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(n > 1, folded).otherwise(F.array(F.raise_error(F.lit("a byte without a rank")).cast("int"))))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """The distinct values of a column of matches with their token ids."""
    one = words.select(F.col(word).alias("word")).filter("word IS NOT NULL AND word != ''").distinct()
    return one.select("word", _let(rank_literal(ranks), lambda maps: fold_merges(F.encode("word", "UTF-8"), maps)).alias("ids"))


class Encoder:
    """Encodes texts with a memory of the words met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        # \s of the tokenizer's library is the White_Space property; Python's own has four more signs
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.words, self.matches = _Memory(self._word), _Memory(self._match)

    def _match(self, match: str) -> bytes:
        ids = merge_pieces(match.encode("utf-8", "surrogatepass"), self.ranks, self.longest)
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(word if word[:1] == "\n" else " " + word)))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers, lowest byte first."""
        if _UNEVEN(text):
            return b"".join(map(self.matches.__getitem__, self.find(text)))
        # no match crosses from a word into the white space behind it, so that where single blanks
        # and line ends stand between words, a word with what stands before it is encoded on its own
        first, *words = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.matches.__getitem__, self.find(first)), *map(self.words.__getitem__, words)])


class _Memory(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        out = self[key] = self.make(key)
        return out


def merge_pieces(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one match: the pair of lowest rank is merged, leftmost first, until none has a rank.

    Pairs wait in a heap; a piece begins at i and ends at after[i] (0: it was merged into its left
    neighbour), so that a match of any length takes about n log n steps.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before, heap = list(range(1, n + 1)), list(range(-1, n)), []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (e := after[j]) - i <= longest and (r := ranks.get(word[i:e])) is not None:
            heappush(heap, (r, i, e))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heappop(heap)
        j = after[i]
        if not 0 < j < n or after[j] != e:
            continue
        after[i], after[j] = e, 0
        if e < n:
            before[e] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False) -> DataFrame:
    """The columns of `keep` with the token ids of every row: an array, or packed as unsigned 32-bit integers."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for batch in slices(batches):
            out = [encoder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, out)]) // 4
            ids = pa.array(out, pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], ids], [*names, "ids"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], f"ids {'binary' if packed else 'array<int>'}"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "ids")


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with `decoded`, the bytes of every row's ids (an array or packed); null ids give none."""
    names = [f"k{i}" for i in range(len(keep))]
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(ids).alias("ids"))
    sent = rows.sparkSession.sparkContext.broadcast(ranks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in sent.value.items()}.__getitem__
        for batch in slices(batches, "ids"):
            col = batch.column("ids")
            parts = ([np.frombuffer(x, np.uint32).tolist() for x in (v or b"" for v in col.to_pylist())] if pa.types.is_binary(col.type) else [x or [] for x in col.to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([b"".join(map(pieces, x)) for x in parts], pa.binary())], [*names, "decoded"])

    schema = ", ".join([*[f"{n} {own.schema[n].dataType.simpleString()}" for n in names], "decoded binary"])
    return own.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "decoded")
