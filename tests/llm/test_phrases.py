"""Phrase mining against plain counting, and its defined results on odd input."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom.llm import phrases


def plain(rows, least, words=5, top=2000, share=100):
    """The definition, with whole numbers of any size."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, words + 1) for i in range(len(w) - m + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = collections.Counter()
    for g, a in found.items():
        for m in range(2, len(g) - 1):
            for i in range(1, len(g) - m + 1):
                sub = (g[0], *g[i:i + m])
                inside[sub] = max(inside[sub], a)
    out = collections.defaultdict(list)
    for g, a in found.items():
        if 100 * inside[g] >= share * a:
            continue
        cuts = []
        for k in range(1, len(g) - 1):
            le, ri = f[g[:k + 1]], f[(g[0], *g[k + 1:])]
            cuts.append((1000 * a * n[g[0]] // (le * ri), k, le, ri))
        score, _, le, ri = min(cuts)
        out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), le, ri))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, listed in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(listed)[:top]))


def text_rows(seed=2, n=300):
    rnd = random.Random(seed)
    vocab = ["the", "of", "New", "york", "a\x01b", "\x00", "Ω", "é", "A", "x9", "zz", "zz\x08"]
    fixed = ["new york the Big apple", "the of the of the of", "one-off, one-off. one-off", "a a a a a a a"]
    rows = []
    for _ in range(n):
        parts = [" ".join(rnd.choices(vocab, weights=range(12, 0, -1), k=rnd.randint(0, 30))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(fixed))
        rows.append((rnd.choice(["en", "en", "en", "fr", None, "und"]), "".join(p + rnd.choice([" ", ". ", "\n", "\t", ";;", "  "]) for p in parts)))
    return rows + [(None, None), ("en", ""), ("de", " . ,"), ("en", "the of " * 3000)]


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(lang, t, "k", 1, 2, "p") for lang, t in rows], "lang string, text string, key string, n long, a long, phrase string").repartition(parts)


def taken(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [3, 20, 100])
def test_equals_the_definition(spark, least):
    rows = text_rows()
    assert taken(phrases.collocations(docs_of(spark, rows), least=least)) == plain(rows, least)


def test_ranges_that_cut_everywhere(spark, monkeypatch):
    # ranges of a few suffixes, so that phrases go on over several of them
    monkeypatch.setattr(phrases, "RANGE", 40)
    rows = text_rows(n=60)
    assert taken(phrases.collocations(docs_of(spark, rows, 5), least=8)) == plain(rows, 8)


def test_hot_phrase_share_and_top(spark):
    rows = [("en", "one very common line of words")] * 400 + [("en", f"one very rare w{i} and w{i % 7} thing") for i in range(200)]
    docs = docs_of(spark, rows, 7)
    assert taken(phrases.collocations(docs, least=5)) == plain(rows, 5)
    assert taken(phrases.collocations(docs, least=5, top=3)) == plain(rows, 5, top=3)
    assert taken(phrases.collocations(docs, least=5, share=60, words=3)) == plain(rows, 5, words=3, share=60)


def test_without_rows(spark):
    docs = docs_of(spark, [("en", "a b c"), (None, None)])
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.filter("lang = 'xx'")).count() == 0


def test_scores_beyond_64_bits(spark):
    a, n = 3 * 10 ** 12, 10 ** 16 + 7
    row = spark.createDataFrame([(a, n, a + 5, a + 9)], "a long, n long, l long, r long")
    found = row.select(F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(14,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")).first()[0]
    assert found == 1000 * a * n // ((a + 5) * (a + 9))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 5)), max_size=60), st.integers(1, 12))
def test_equal_partitions_are_counts(listed, least):
    codes = np.zeros((len(listed), 4), np.int32)
    for i, (row, _) in enumerate(listed):
        codes[i, :len(row)] = row
    weights = np.array([w for _, w in listed], np.int64)
    count = collections.Counter()
    for row, w in listed:
        for d in range(1, len(row) + 1):
            count[tuple(row[:d])] += w
    ends = [tuple(min(r for r, _ in listed)), tuple(max(r for r, _ in listed))] if listed else []
    edge = {e[:d] for e in ends for d in range(1, len(e) + 1)}
    found = [(tuple(codes[at, :d].tolist()), n) for d, at, n in phrases.equal_partitions(codes, weights, least)]
    assert sorted(found) == sorted((g, n) for g, n in count.items() if n >= least or g in edge)


def test_hashes_and_bits_are_sparks(spark):
    words = [b"alpha", "Ωmega".encode(), b"", b"x" * 100, b"\x00\x01"]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, word binary")
    got = {bytes(r.word): r.h & (1 << 64) - 1 for r in df.select("word", F.xxhash64("lang", "word").alias("h")).collect()}
    mine = phrases.word_hashes("en", words)
    assert [got[w] for w in words] == mine.tolist()
    assert xxhash.xxh64_intdigest(b"alpha", xxhash.xxh64_intdigest(b"en", 42)) == got[b"alpha"]
    table = phrases.bit_table(df.select(F.xxhash64("lang", "word").alias("h")), 16)
    assert phrases.is_set(table, 16, mine).all()
    assert np.unpackbits(table).sum() == len({int(h) & 0xFFFF for h in mine})
