"""The prefix table tokenizer against the library, and its defined results on odd input."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from meterloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = pieces.read_vocabulary(PATH)
ENCODER, DECODER = pieces.Encoder(VOCABULARY), pieces.Decoder(VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SIGNS = ["a", "b", "in", "the", " ", "   ", "▁", "\n", "\t", "\x00", "é", "ﷺ", "😀", "00", "==", ".", "　", "語", "\r\n"]


def ids_of(text):
    return [int(x) for x in memoryview(ENCODER.encode(text)).cast("i")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SIGNS) | st.characters(exclude_categories=("Cs",)), max_size=40).map("".join))
def test_ids_and_texts_are_the_librarys(text):
    ids = ids_of(text)
    assert ids == LIBRARY.encode(text)
    assert DECODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("sign", [" ", "▁", "a", "=", "\n", "ha", "é"])
def test_runs_of_every_length(sign):
    for n in [*range(40), 255, 1000]:
        for text in (sign * n, f"x{sign * n}y", f" {sign * n} "):
            assert ids_of(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 262), max_size=14))
def test_any_ids_decode_as_in_the_library(ids):
    assert DECODER.decode(ids) == LIBRARY.decode(ids)


def test_long_text_without_blanks_in_linear_time():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abehinstr,.", k=200_000))
    assert ids_of(text) == LIBRARY.encode(text)


def test_small_memories_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 500)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    encoder = pieces.Encoder(VOCABULARY)
    text = " ".join(random.Random(4).choices(["one", "of", "these", "words", "ends."], k=400))
    assert memoryview(encoder.encode(text)).cast("i").tolist() == LIBRARY.encode(text)


def small_model(path, listed, **flags):
    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 2, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    for k, v in flags.items():
        setattr(m.normalizer_spec, k, v)
    for text, kind, score in [("<unk>", 2, 0), ("<s>", 3, 0), ("</s>", 3, 0), *[(f"<0x{b:02X}>", 6, 0) for b in range(256)], *[(t, 1, s) for t, s in listed]]:
        p = m.pieces.add()
        p.piece, p.type, p.score = text, kind, score
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("front", [True, False])
def test_pieces_with_inner_marks_and_ties(tmp_path, front):
    # merges reach over marks, scores tie, and one piece cannot be built from others
    listed = [("aa", -1), ("ab", -1), ("a▁", -2), ("▁a", -2), ("aab", -3), ("a▁a", -3), ("aaaa", -3), ("b▁a▁", -4), ("xyz", -1), ("▁▁", -5), *[(c, -9) for c in "ab▁"]]
    path = small_model(tmp_path / "m.model", listed, add_dummy_prefix=front)
    v = pieces.read_vocabulary(path)
    assert not v.cut
    encoder, library, rnd = pieces.Encoder(v), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choices("aaab x", k=rnd.randint(0, 14)))
        ids = memoryview(encoder.encode(text)).cast("i").tolist()
        assert ids == library.encode(text), text
        assert pieces.Decoder(v).decode(ids) == library.decode(ids)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        pieces.read_vocabulary(small_model(tmp_path / "a.model", [("a", -1)], remove_extra_whitespaces=True))
    with pytest.raises(ValueError):  # ab is merged before its part b▁ could be
        pieces.read_vocabulary(small_model(tmp_path / "b.model", [("ab", -5), ("abc", -1), ("a", 0), ("b", 0), ("c", 0)]))


def test_tables(spark):
    rows = [(1, "One two  three"), (2, None), (3, ""), (4, "a " * 70_000), (4, "One two  three"), (None, "▁x"), (6, "🙂" * 3)]
    docs = spark.createDataFrame([(i, t, "k", [1], i) for i, t in rows], "doc_id long, text string, decoded string, ids array<int>, k0 long").repartition(3)
    out = pieces.decode(pieces.encode(docs, VOCABULARY), VOCABULARY, keep=("doc_id", "ids")).collect()
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in out)
    want = sorted((i or 0, LIBRARY.encode(t or "", add_eos=True), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows)
    assert got == want
    bare = pieces.encode(docs, VOCABULARY, end=False).filter("doc_id = 2").first()
    assert bare.ids == []
    assert pieces.encode(docs.limit(0), VOCABULARY).count() == 0
    gone = docs.select(F.lit(None).cast("array<int>").alias("ids"), "doc_id")
    assert {r.decoded for r in pieces.decode(gone, VOCABULARY).collect()} == {""}


def test_query_against_the_library(spark, tmp_path):
    rows = [(1, "Eins, zwei\nDREI"), (2, None), (3, "x" * 300 + " y"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op12_sentencepiece(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(dict(rows)[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
