"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and the pieces into words at
blanks and tabs. A phrase is a run of 2 to `words` words of one piece; everything is counted for each
language on its own.

Three passes over the texts:

1. words: counts, summed up in the task before they move. The frequent ones are also kept as bits of a
   table of fixed size.
2. pairs of frequent words: counts of 64-bit hashes, summed up in the same way, and kept as bits. Different
   words or pairs may share a bit, which only lets more suffixes through.
3. suffixes: every position whose pair may be frequent starts a suffix of up to `words` words, ended before
   the first pair that cannot be frequent. Suffixes of just two words are summed up in the task.

Suffixes are routed by their leading words: a range partitioning by (language, words), which also cuts
within equal rows, so that no leading word or suffix fills a task. Each task sorts pointers to its
suffixes by three-way quicksort, word by word: the size of an equal-partition is the count of its
phrase, and partitions of fewer than `least` are abandoned. A task's first and last suffix may go on in
its neighbours; the partial counts of their phrases are always sent, and summed up by phrase.

Memory of a task: a slice of texts and up to HELD words in the passes; the number of ranges follows the number of suffixes, so
that one holds about `RANGE` rows. The bit tables (6 MB) are all that is broadcast by name. Where counts of
parts are looked up, phrases are spread over `SALTS` copies of the counts, since many share a frequent word.

Defined results: null and empty texts have no words; a null language is `und` and joins a language of
that name. Repeated rows count as often as they occur. Equal scores are ordered by count, then by phrase.
Empty tables, and tables without a phrase of `least` occurrences, give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import slices

LEAST, WORDS, TOP, SHARE = 100, 5, 2000, 100
SLICE = 8 << 20  # bytes of text coded at a time
HELD = 1_000_000  # words of a task's numbering, before it begins anew
RANGE, SALTS = 1_500_000, 8
WORD_BITS, PAIR_BITS = 24, 25
_BREAK = b"."
_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")
#: In a row's key words are joined by a zero byte; no word has byte 9, so that the lower ones can move up by one and keep their order.
_UP, _DOWN = bytes.maketrans(bytes(range(9)), bytes(range(1, 10))), bytes.maketrans(bytes(range(1, 10)), bytes(range(9)))


class _Codes(dict):
    """Numbers of a language's words in the order in which a task meets them; the break is 0."""

    def __init__(self, lang: str):
        self.lang, self.words, self.hashes = lang, [_BREAK], np.empty(0, np.uint64)
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def hashed(self) -> np.ndarray:
        """64-bit hashes of all words by number."""
        self.hashes = np.concatenate((self.hashes, word_hashes(self.lang, self.words[len(self.hashes):])))
        return self.hashes

    def keys(self, codes: np.ndarray) -> pa.Array:
        """The words of each row of codes (0: none) as one key."""
        named = pa.array([None, *[w.translate(_UP) for w in self.words[1:]]], pa.binary())
        columns = [named.take(pa.array(codes[:, j])) for j in range(codes.shape[1])]
        return pc.binary_join_element_wise(*columns, pa.scalar(b"\0", pa.binary()), null_handling="skip")


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Codes, np.ndarray]]:
    """(words, numbers of the words in text order with 0 between pieces) of each language of each slice of (lang, text)."""
    known: dict[str, _Codes] = {}
    for batch in slices(batches, "text", SLICE):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            codes = known.setdefault(lang, _Codes(lang))
            tokens = _BREAK.join(own).translate(_SIGNS).replace(_BREAK, b" . ").split()
            yield codes, np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
        if sum(map(len, known.values())) > HELD:
            known = {}


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64(lang, word) gives."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits, those of the hashes (column h, long) set; of fixed size, whatever the number of rows."""
    cell = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(cell).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in rows:
        start = (r["at"] - 1) * 4096
        out[start:start + 4096] = np.frombuffer(r["bits"], np.uint8)[:len(out) - start]
    return out


def is_set(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    cell = h & np.uint64((1 << bits) - 1)
    return (table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for codes, numbers in coded(batches):
        n = np.bincount(numbers)
        some = np.flatnonzero(n[1:]) + 1
        words, counts = [None, *[codes.words[i] for i in some]], [int(n[1:].sum()), *n[some]]  # first: the language as a whole
        yield pa.RecordBatch.from_arrays([pa.array([codes.lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])


def _count_pairs(sent):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty(0, np.uint64)], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for codes, numbers in coded(batches):
            h = codes.hashed()
            often = is_set(sent.value, WORD_BITS, h)
            often[0] = False
            both = np.flatnonzero(often[numbers[:-1]] & often[numbers[1:]])
            held.append(pair_hashes(h[numbers[both]], h[numbers[both + 1]]))
            size += len(both)
            if size > 4_000_000:
                yield out()
                held, size = held[:1], 0
        yield out()

    return task


def _suffixes(sent, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, pair_table = sent.value
        salt, short = 0, {}

        def rows(codes: _Codes, listed: np.ndarray, n) -> pa.RecordBatch:
            nonlocal salt
            salts = (salt + np.arange(len(listed), dtype=np.int64)) * 40503 & 0xFFFF
            salt += len(listed)
            return pa.RecordBatch.from_arrays([pa.array([codes.lang] * len(listed), pa.string()), codes.keys(listed), pa.array(n, pa.int64()), pa.array(salts, pa.int32())], ["lang", "key", "n", "salt"])

        def pairs() -> Iterator[pa.RecordBatch]:
            for codes, parts in short.values():
                packed, n = np.unique(np.concatenate(parts), return_counts=True)
                yield rows(codes, np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1), n)
            short.clear()

        for codes, numbers in coded(batches):
            h = codes.hashed()
            often = is_set(word_table, WORD_BITS, h)
            often[0] = False
            goes_on = np.zeros(len(numbers) + width, bool)
            both = np.flatnonzero(often[numbers[:-1]] & often[numbers[1:]])
            goes_on[both] = is_set(pair_table, PAIR_BITS, pair_hashes(h[numbers[both]], h[numbers[both + 1]]))
            at = np.flatnonzero(goes_on[:-1] & ~goes_on[1:])
            short.setdefault(id(codes), (codes, []))[1].append(numbers[at].astype(np.int64) << 32 | numbers[at + 1])
            at = np.flatnonzero(goes_on[:-1] & goes_on[1:])
            listed = np.zeros((len(at), width), np.int32)
            listed[:, 0] = numbers[at]
            still = np.ones(len(at), bool)
            for j in range(1, width):
                still &= goes_on[at + j - 1]
                listed[still, j] = numbers[at[still] + j]
            yield rows(codes, listed, np.ones(len(at), np.int64))
            if sum(len(p) for _, parts in short.values() for p in parts) > 4_000_000:
                yield from pairs()
        yield from pairs()

    return task


def equal_partitions(codes: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(words, place of a suffix, weight) of every prefix of `least` or more, and of every prefix of the first and last suffix.

    `codes` has a suffix in each row, numbers in the words' order, 0 behind its end; `weights` says how often it occurs.
    """
    if not len(codes):
        return
    width = codes.shape[1]
    order = np.arange(len(codes))
    for j in range(width):  # the smallest and the largest row, column by column
        order = order[codes[order, j] == codes[order, j].min()]
    first = codes[order[0]].tolist()
    order = np.arange(len(codes))
    for j in range(width):
        order = order[codes[order, j] == codes[order, j].max()]
    last = codes[order[0]].tolist()
    stack = [(np.arange(len(codes)), 0, True, True)]
    while stack:
        p, d, lo, hi = stack.pop()  # lo, hi: the partition shares the first d words of the first, last suffix
        key = codes[p, d]
        some = key[::max(1, len(key) // 64)]
        pivot = int(np.partition(some, len(some) // 2)[len(some) // 2])
        for side, has in (((key < pivot), lambda x: x < pivot), ((key > pivot), lambda x: x > pivot)):
            q = p[side]
            if len(q):
                low, high = lo and has(first[d]), hi and has(last[d])
                if low or high or weights[q].sum() >= least:
                    stack.append((q, d, low, high))
        if pivot:
            q = p[key == pivot]
            low, high, n = lo and first[d] == pivot, hi and last[d] == pivot, int(weights[q].sum())
            if low or high or n >= least:
                yield d + 1, int(q[0]), n
                if d + 1 < width:
                    stack.append((q, d + 1, low, high))


def _sort_task(least: int, width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, keys, weights = [], [], []
        for batch in batches:
            langs.append(batch.column("lang").cast(pa.binary()).dictionary_encode())
            keys += batch.column("key").to_pylist()
            weights.append(batch.column("n").to_numpy())
        if not keys:
            return
        lang = pa.chunked_array(langs).combine_chunks().to_pylist()
        flat = b"\0".join(keys).split(b"\0")
        sizes = np.fromiter((k.count(b"\0") + 1 for k in keys), np.int64, len(keys))
        words = sorted({*flat, *lang})
        number = {w: i + 1 for i, w in enumerate(words)}
        codes = np.zeros((len(keys), width + 1), np.int32)
        codes[:, 0] = np.fromiter(map(number.__getitem__, lang), np.int32, len(lang))
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes[np.repeat(np.arange(len(keys)), sizes), column + 1] = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        named, found = [w.translate(_DOWN) for w in words], []
        for d, at, n in equal_partitions(codes, np.concatenate(weights), least):
            if d > 2:  # a language and two words
                found.append((words[codes[at, 0] - 1].decode(), b" ".join(named[c - 1] for c in codes[at, 1:d]), d - 1, n))
        cols = list(zip(*found)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int64()))], ["lang", "phrase", "words", "a"])

    return task


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a of all phrases of 2 to `words` words with a >= least) and (lang, word, n of all frequent words; a null word has all of the language)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    counts = rows.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    singles = cut_lineage(counts.filter((F.col("n") >= least) | F.col("word").isNull()))
    word_table = bit_table(singles.filter("word IS NOT NULL").select(F.xxhash64("lang", "word").alias("h")), WORD_BITS)
    sent = spark.sparkContext.broadcast(word_table)
    pairs = cut_lineage(rows.mapInArrow(_count_pairs(sent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    expected = pairs.agg(F.sum("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast((word_table, bit_table(pairs, PAIR_BITS)))
    suffixes = rows.mapInArrow(_suffixes(sent, words), "lang string, key binary, n long, salt int")
    ranges = max(-(-expected // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // 50_000)), 1)
    routed = suffixes.repartitionByRange(ranges, "lang", "key", "salt")
    found = routed.mapInArrow(_sort_task(least, words), "lang string, phrase binary, words int, a long")
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return cut_lineage(found.withColumn("phrase", F.col("phrase").cast("string"))), singles


def looked_up(rows: DataFrame, counts: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Inner join of rows with counts that have one row for each key; rows of a frequent key go to SALTS copies of it."""
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of every language."""
    found, singles = frequent_phrases(docs, text, lang, least, words)
    total = singles.filter("word IS NULL").select("lang", "n")
    counts = singles.filter("word IS NOT NULL").select("lang", F.col("word").cast("string").alias("part"), F.col("n").alias("f"))
    counts = counts.union(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))

    parts = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(parts, start, n), " ")
    # of the phrases that hold a phrase, the most frequent one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n))))
    longer = found.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = found.join(longer, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = looked_up(cuts, counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side], F.col("phrase"))
    cuts = looked_up(cuts, total, ["lang"], F.col("phrase"))
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(14,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")

    order = "ORDER BY score DESC, a DESC, phrase"
    spread = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = spread.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
