"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Tokens are the words between ASCII blanks (A-Z lower-cased), then one end of text. Counts of all
words, pairs and triples of the learning texts make the model

    p1(w) = (c(w) + 1) / (N + V + 1)
    pn(w | u) = (c(u w) + r p(w | shorter u)) / (c(u) + r),  r = c(u) ** GROWTH

where r stands for the number of different followers of u (Heaps' law); every level sums to 1. A
text's probability is an even mixture of two models of whole texts: p1 for every token, and an even
mixture of p1 and p3 for every token. So n-grams that say nothing cost at most 0.3 in all.

How it is spread. Documents are dealt into batches of about `BATCH` bytes by a hash of their id. A
batch lists its distinct words, pairs and triples, sorted, with their counts in learning texts, and
sends each stretch of the list to the shard that owns it (a hash of the whole n-gram, so that a
frequent context is spread over all shards). A shard merges the lists into its part of the trie:
per order a context level and a follower level. Sorted contexts, the monotone pointers to their
followers and the followers themselves (numbered within their context) are Elias-Fano coded, the
log-frequencies from which the smoothed probabilities are formed are quantised to 16 bits, and all
lie in one memory-mapped file. The shard answers the batches' lists by finding the context, then
the successor of the follower within the context's range, and the answers go back to the batches,
which add up the scores. Words are told apart by 64 bits; a follower by 30 bits within its
context in a shard of about two million n-grams (less than one false match in 100,000 look-ups).

Defined results: a null text is an empty one, whose only token is the end. A null id is learned from
if the caller's flag says so. Repeated rows count each time. With nothing to learn from, N and V are
0 and every p1 is 1. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import _Hashes

ORDER, GROWTH = 3, 0.85
BATCH, SHARD = 12 << 20, 8 << 20
CONTEXT_BITS, WORD_BITS = 14, 30
_END, _START = np.uint64(1), np.uint64(2)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
EXACT, RATIO = 1 << 15, 10 ** (10 / (1 << 15))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- Elias-Fano ---------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, bits: int):
        self.low, self.n, self.bits = low, n, bits
        self.ones = np.flatnonzero(np.unpackbits(high))[:n]
        top = int(self.ones[-1]) - n + 1 if n else 0
        self.start = np.searchsorted(self.ones - np.arange(n), np.arange(top + 2)) if n else np.zeros(2, np.int64)

    @staticmethod
    def pack(values: np.ndarray) -> tuple[bytes, bytes, int, int]:
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, min(50, (most // max(n, 1)).bit_length() - 1)) if most >= n else 0
        v = values.astype(np.uint64)
        if bits:
            rows = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(rows.reshape(-1), bitorder="little").tobytes()
        else:
            low = b""
        high = np.zeros(n + (most >> bits) + 1, np.uint8)
        high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return low + bytes(8), np.packbits(high).tobytes(), n, bits

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        high = (self.ones[i] - i).astype(np.uint64)
        if not self.bits:
            return high
        bit = i.astype(np.int64) * self.bits
        window = np.lib.stride_tricks.as_strided(self.low[:8].view(np.uint64), (len(self.low) - 7,), (1,))
        low = (window[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        return (high << np.uint64(self.bits)) | low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is at least x; n if there is none."""
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = h < len(self.start) - 1
        h = np.where(inside, h, 0)
        lo, hi = np.where(inside, self.start[h], self.n), np.where(inside, self.start[np.minimum(h + 1, len(self.start) - 1)], self.n)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.at(mid) < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


def quantise(n: np.ndarray) -> np.ndarray:
    """Counts as 16-bit steps of their logarithm; exact up to 2**15, 0 for absent."""
    big = EXACT + np.log(np.maximum(n, EXACT) / EXACT) / np.log(RATIO)
    return np.where(n <= EXACT, n, np.minimum(np.rint(big), 65535)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float64)
    return np.where(x <= EXACT, x, EXACT * RATIO ** (x - EXACT))


class Level:
    """One order of a shard's trie, memory-mapped: contexts, pointers, followers, quantised values."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, folder: str, name: str):
        mask = np.uint64((1 << WORD_BITS) - 1)
        context = keys >> np.uint64(WORD_BITS)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        parts = [EliasFano.pack(context[first]), EliasFano.pack(np.append(first, len(keys))), EliasFano.pack((number.astype(np.uint64) << np.uint64(WORD_BITS)) | (keys & mask))]
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            spots = []
            for low, high, n, bits in parts:
                spots.append((f.tell(), len(low), len(high), n, bits))
                f.write(low + high)
            codes = f.tell() + f.tell() % 2
            f.write(bytes(f.tell() % 2) + quantise(counts).tobytes())
        data = np.memmap(path, np.uint8, "r")
        self.contexts, self.pointers, self.followers = (EliasFano(data[at:at + a], data[at + a:at + a + b], n, bits) for at, a, b, n, bits in spots)
        self.codes = data[codes:].view(np.uint16)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Quantised value of every n-gram key, 0 where it is absent."""
        out = np.zeros(len(keys), np.uint16)
        if not self.contexts.n or not len(keys):
            return out
        context, word = keys >> np.uint64(WORD_BITS), keys & np.uint64((1 << WORD_BITS) - 1)
        at = self.contexts.successor(context)
        ok = np.flatnonzero(at < self.contexts.n)
        ok = ok[self.contexts.at(at[ok]) == context[ok]]
        wanted = (at[ok].astype(np.uint64) << np.uint64(WORD_BITS)) | word[ok]
        spot = self.followers.successor(wanted)
        inside = spot < self.pointers.at(at[ok] + 1).astype(np.int64)
        ok, wanted, spot = ok[inside], wanted[inside], spot[inside]
        same = self.followers.at(spot) == wanted
        out[ok[same]] = self.codes[spot[same]]
        return out


# --- batches ------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as differences, low and high halves apart (the high ones are nearly all 0)."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64))
    return zstandard.compress((steps & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (steps >> np.uint64(32)).astype(np.uint32).tobytes(), 1)


def _unpack_sorted(blob: bytes) -> np.ndarray:
    low, high = np.frombuffer(zstandard.decompress(blob), np.uint32).reshape(2, -1).astype(np.uint64)
    return np.cumsum((high << np.uint64(32)) | low)


class Tokens:
    """Token hashes of a batch of texts, the key of every token's n-gram of each order, and the distinct keys."""

    def __init__(self, texts: list[str | None], shard_bits: int):
        known = _Hashes()
        parts, lens = [], []
        for t in texts:
            words = words_of(t)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            parts.append(np.array([_END]))
            lens.append(len(words) + 1)
        self.lens = np.array(lens, np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.lens) - self.lens
        self.shard_bits = shard_bits

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """Each token's predecessor's value; `at_start` for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def keys(self, order: int) -> np.ndarray:
        if order == 1:
            return self.words
        last = self.before(self.words, _START)
        context = _mix(last + np.uint64(order))
        if order == 3:
            context = _mix(context + self.before(last, _START) * np.uint64(0x9E3779B97F4A7C15))
        word = _mix(self.words + context * np.uint64(0xD6E8FEB86659FD93))  # differs between contexts that share their bits
        spread = _mix(context * np.uint64(3) + word)
        own = np.uint64(64 - CONTEXT_BITS - WORD_BITS)
        key = ((context >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS)) | (word >> np.uint64(64 - WORD_BITS))
        shard = spread >> np.uint64(64 - self.shard_bits) if self.shard_bits else np.zeros(len(key), np.uint64)
        return (shard << (np.uint64(64) - own)) | key

    def cuts(self, distinct: np.ndarray, order: int) -> np.ndarray:
        """Where each shard's stretch of the sorted distinct keys begins, and the end."""
        shift = 64 - self.shard_bits if order == 1 else CONTEXT_BITS + WORD_BITS
        edges = np.arange(1, 1 << self.shard_bits, dtype=np.uint64) << np.uint64(shift % 64)
        return np.concatenate(([0], np.searchsorted(distinct, edges), [len(distinct)]))


def _lists_task(shard_bits: int, order: int):
    """The lists that a batch sends, a row for each shard."""

    def task(table: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("text").to_pylist(), shard_bits)
        learn = np.repeat(np.array(table.column("learn").to_pylist(), bool), tokens.lens)
        shards = 1 << shard_bits
        cols: dict[str, list] = {"shard": list(range(shards)), "batch": [table.column("batch")[0].as_py()] * shards}
        for n in range(1, order + 1):
            keys, at = np.unique(tokens.keys(n), return_inverse=True)
            counts = np.bincount(at, learn, len(keys)).astype(np.uint32)
            cuts = tokens.cuts(keys, n)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF if n == 1 else (1 << (CONTEXT_BITS + WORD_BITS)) - 1)
            cols[f"k{n}"] = [_pack_sorted(keys[a:b] & mask) for a, b in zip(cuts, cuts[1:])]
            cols[f"c{n}"] = [_pack(counts[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({k: pa.array(v, pa.int32() if k == "shard" else pa.int64() if k == "batch" else pa.binary()) for k, v in cols.items()})

    kinds = ", ".join(f"k{n} binary, c{n} binary" for n in range(1, order + 1))
    return task, f"shard int, batch long, {kinds}"


def _shard_task(order: int):
    """Merge the lists of one shard into its trie and answer every batch."""

    def task(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_pylist()
        answers: dict[str, list] = {}
        tokens = words = 0
        with tempfile.TemporaryDirectory() as folder:
            for n in range(1, order + 1):
                asked = [_unpack_sorted(x) for x in table.column(f"k{n}").to_pylist()]
                counts = [np.frombuffer(zstandard.decompress(x), np.uint32) for x in table.column(f"c{n}").to_pylist()]
                learnt = [c > 0 for c in counts]
                every, number = np.concatenate([k[m] for k, m in zip(asked, learnt)]), np.concatenate([c[m] for c, m in zip(counts, learnt)])
                keys, at = np.unique(every, return_inverse=True)
                total = np.bincount(at, number, len(keys)).astype(np.int64)
                del every, number, at, counts
                if n == 1:  # words keep their exact counts
                    tokens, words = int(total.sum()), len(keys)
                    spots = [np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1)) for k in asked]
                    answers["a1"] = [_pack(np.where(keys[s] == k, total[s], 0) if len(keys) else np.zeros(len(k), np.int64)) for k, s in zip(asked, spots)]
                else:
                    level = Level(keys, total, folder, f"level{n}")
                    answers[f"a{n}"] = [_pack(level.look_up(k)) for k in asked]
                    del level
        out = {"batch": pa.array(batches, pa.int64()), "shard": table.column("shard"), "tokens": pa.array([tokens] * len(batches), pa.int64()), "words": pa.array([words] * len(batches), pa.int64())}
        return pa.table(out | {k: pa.array(v, pa.binary()) for k, v in answers.items()})

    kinds = ", ".join(f"a{n} binary" for n in range(1, order + 1))
    return task, f"batch long, shard int, tokens long, words long, {kinds}"


def text_scores(c: list[np.ndarray], first: np.ndarray, end_count: float, n: int, v: int, before) -> tuple[np.ndarray, np.ndarray]:
    """(base, score) of every text from its tokens' counts per order; `before` shifts to the predecessor."""
    p1 = (c[0] + 1) / (n + v + 1)
    p, context = p1, before(c[0].astype(np.float64), end_count)
    for k in range(1, len(c)):
        room = context ** GROWTH
        p = np.where(context > 0, (c[k] + room * p) / np.maximum(context + room, 1e-300), p)
        context = before(c[k], 0.0)  # a first token has no longer context
    base = np.add.reduceat(np.log10(p1), first)
    mixed = np.add.reduceat(np.log10(0.5 * p1 + 0.5 * p), first)
    high, low = np.maximum(base, mixed), np.minimum(base, mixed)
    return base, high + np.log10(0.5 + 0.5 * 10 ** np.maximum(low - high, -300))


def _score_task(shard_bits: int, order: int):
    def task(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({c: pa.array([], pa.float64() if c in ("base", "score") else pa.int64()) for c in ("id", "n_tokens", "n_known", "train_tokens", "base", "score")})
        tokens = Tokens(docs.column("text").to_pylist(), shard_bits)
        answers = answers.sort_by("shard")
        n, v = sum(answers.column("tokens").to_pylist()), sum(answers.column("words").to_pylist())
        counts, end_count = [], 0.0
        for k in range(1, order + 1):
            said = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64 if k == 1 else np.uint16) for x in answers.column(f"a{k}").to_pylist()])
            distinct, at = np.unique(tokens.keys(k), return_inverse=True)
            if k == 1:
                end_count = float(said[np.searchsorted(distinct, _END)])
            counts.append(said[at] if k == 1 else dequantise(said)[at])
        base, score = text_scores(counts, tokens.first, end_count, n, v, tokens.before)
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), tokens.first)
        return pa.table({"id": docs.column("id"), "n_tokens": pa.array(tokens.lens), "n_known": pa.array(known), "train_tokens": pa.array([n] * len(docs), pa.int64()), "base": pa.array(base), "score": pa.array(score)})

    return task, "id long, n_tokens long, n_known long, train_tokens long, base double, score double"


def score_texts(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, batch_bytes: int = BATCH, shard_bytes: int = SHARD) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base, score of every row; rows where `learn` holds are learned from."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    shard_bits = max(0, (size // shard_bytes).bit_length())
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches))).repartition(batches, "batch")
    task, schema = _lists_task(shard_bits, order)
    lists = dealt.groupBy("batch").applyInArrow(task, schema)
    task, schema = _shard_task(order)
    answers = lists.groupBy("shard").applyInArrow(task, schema)
    task, schema = _score_task(shard_bits, order)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(task, schema)
