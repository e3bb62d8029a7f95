"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

Every prefix of a text has one encoding, so it has one last token. The table holds that token for each
prefix, from left to right: an automaton over the vocabulary names all tokens that end there, and the
last token is the one that is compatible with the last token of the prefix before it. Two tokens are
compatible if no merge across their border would have been made while their own merges went on; that
is read off the tokens' own merge trees, from the last merge back. The ids are recovered backwards from
the end of the table. A text takes linear time, whatever its length.

The model's rules: blanks become the mark U+2581 and one is put before the text; the pair of best score
is merged first, leftmost first among equals; characters outside the vocabulary are spelled in byte
pieces. Where no piece has a mark behind another character (`Vocabulary.cut` is derived from the pieces),
a text is cut before its marks and each part is encoded on its own, with a memory of parts met
lately, bounded in characters.

Defined results: null and empty texts have the end id only (no ids at all without it), and decode to the
empty text; null ids decode to it too. Repeated rows repeat their result, an empty table gives no rows.
Other columns are ignored, whatever their names. A model of another type, with text normalisation,
user-defined pieces, no byte pieces, or scores that rise along a piece's own merges raises ValueError.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

MARK = "▁"
MEMORY = 24_000_000  # characters and ids that a task's memory of parts may hold
LONGEST = 128  # characters of a part that is remembered
PAIRS = 1_000_000  # compatibility tests remembered
_PART = re.compile(" +[^ ]*").findall


@dataclass(frozen=True)
class Vocabulary:
    names: list[str]  # pieces that take part in merges
    ids: list[int]
    ranks: list[float]  # lower is merged first
    left: list[int]  # the piece's own last merge; -1 for single characters
    right: list[int]
    byte_ids: list[int]
    spelled: dict[int, bytes]  # id -> bytes that decoding joins
    unknown: int
    end: int
    front: bool  # a blank is put before every text
    cut: bool  # no piece has the mark behind another character


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file with their merge trees."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, trained, kinds = model.normalizer_spec, model.trainer_spec, proto.ModelProto.SentencePiece
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("not a merge-type model with byte pieces")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError("models that normalise texts are not supported")
    names, ids, ranks, byte_ids, spelled, unknown, end = [], [], [], [-1] * 256, {}, 0, -1
    for i, p in enumerate(model.pieces):
        if p.type == kinds.NORMAL:
            names.append(p.piece)
            ids.append(i)
            ranks.append(-p.score)
            spelled[i] = p.piece.replace(MARK, " ").encode()
        elif p.type == kinds.BYTE:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte], spelled[i] = i, bytes([byte])
        elif p.type == kinds.UNKNOWN:
            unknown, spelled[i] = i, (trained.unk_surface or " ⁇ ").encode()
        elif p.type == kinds.CONTROL:
            spelled[i] = b""
            if p.piece == (trained.eos_piece or "</s>"):
                end = i
        else:
            raise ValueError("user-defined and unused pieces are not supported")
    left, right = merge_trees(names, ranks)
    if min(byte_ids) < 0 or any(x >= 0 and left[x] >= 0 and ranks[x] > r for sides in (left, right) for x, r in zip(sides, ranks)):
        raise ValueError("byte pieces are missing, or scores rise along merges")
    cut = not any(b == MARK and a != MARK for name in names for a, b in zip(name, name[1:]))
    return Vocabulary(names, ids, ranks, left, right, byte_ids, spelled, unknown, end, normal.add_dummy_prefix, cut)


def merge_trees(names: list[str], ranks: list[float]) -> tuple[list[int], list[int]]:
    """The two pieces of every piece's last merge when it is encoded alone; -2 if it is no token of its own text."""
    index = {name: i for i, name in enumerate(names)}
    left, right = [-1] * len(names), [-1] * len(names)
    for i, name in enumerate(names):
        parts = list(name)
        while len(parts) > 1:
            joint = [(ranks[z], k) for k in range(len(parts) - 1) if (z := index.get(parts[k] + parts[k + 1])) is not None]
            if not joint:
                left[i] = right[i] = -2
                break
            k = min(joint)[1]
            left[i], right[i] = index[parts[k]], index[parts[k + 1]]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return left, right


class Encoder:
    """Prefix tables over one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.index = {name: i for i, name in enumerate(v.names)}
        self.sizes = list(map(len, v.names))
        self.automaton = ahocorasick.Automaton()
        for i, name in enumerate(v.names):
            if v.left[i] != -2:
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.parts = _Memory(self._part)
        self.pairs: dict[int, bool] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether piece y may stand behind piece x: their merges are undone, latest first, and no merge across came before the next."""
        names, ranks, left, right = self.v.names, self.v.ranks, self.v.left, self.v.right
        ends_x = ends_y = float("inf")  # rank of the merge that took x, y into a larger piece
        while True:
            z = self.index.get(names[x] + names[y])
            # among equal ranks the leftmost goes first: x's own merge lies left of the border, y's right of it
            if z is not None and ranks[z] < ends_x and ranks[z] <= ends_y:
                return False
            if left[x] < 0 and left[y] < 0:
                return True
            if left[y] >= 0 and (left[x] < 0 or ranks[y] >= ranks[x]):
                ends_y, y = ranks[y], left[y]
            else:
                ends_x, x = ranks[x], right[x]

    def _part(self, text: str) -> bytes:
        """Ids of a text whose blanks are marks already."""
        n, sizes, pairs = len(text), self.sizes, self.pairs
        last = [-1] * (n + 1)  # the last token of each prefix; -1: a character outside the vocabulary
        for e, t in self.automaton.iter(text):
            e += 1
            if last[e] >= 0:
                continue
            p = last[e - sizes[t]] if e > sizes[t] else -1
            if p >= 0:
                fits = pairs.get(key := p << 32 | t)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(p, t)
                if not fits:
                    continue
            last[e] = t
        out, ids, e = [], self.v.ids, n
        while e:
            if (t := last[e]) >= 0:
                out.append(ids[t])
                e -= sizes[t]
            else:
                out += [self.v.byte_ids[b] for b in reversed(text[e - 1].encode("utf-8", "surrogatepass"))]
                e -= 1
        return array("i", reversed(out)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, without the end id."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if self.v.front:
            text = " " + text
        if not self.v.cut:
            return self._part(text.replace(" ", MARK))
        head = b""
        if text[0] != " ":
            first, blank, rest = text.partition(" ")
            head, text = self._part(first), blank + rest
        if "  " in text:
            parts = [p.replace(" ", MARK) for p in _PART(text)]
        else:
            parts = text.replace(" ", " " + MARK).split(" ")[1:]
        return head + b"".join(map(self.parts.__getitem__, parts))


class _Memory(dict):
    """Results of a function for arguments met lately."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= LONGEST:
            self.held += len(key) + len(out) // 4 + 32
            if self.held > MEMORY:
                self.clear()
                self.held = 0
            self[key] = out
        return out


class Decoder:
    """Texts of ids, as the library spells them."""

    def __init__(self, v: Vocabulary):
        self.spelled, self.front = v.spelled, v.front
        self.bytes = set(v.byte_ids)
        self.blank = {i for i, s in v.spelled.items() if s[:1] == b" " and i != v.unknown and i not in self.bytes}
        self.silent = {i for i, s in v.spelled.items() if not s}

    def decode(self, ids: list[int]) -> str:
        joined = b"".join(map(self.spelled.__getitem__, ids))
        if self.front:
            first = next((i for i in ids if i not in self.silent), None)
            if first in self.blank:
                joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:  # every byte that begins no character is a character of its own
            return "".join(_characters(joined))


def _characters(raw: bytes) -> Iterator[str]:
    i = 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                yield raw[i:i + n].decode()
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            i += 1


def _columns(rows: DataFrame, keep: tuple[str, ...], column: str, name: str) -> tuple[DataFrame, list[str], str]:
    names = [f"k{i}" for i in range(len(keep))]
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(column).alias(name))
    return own, names, "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end: bool = True) -> DataFrame:
    """The columns of `keep` with `ids`, the token ids of every row, by default with the end id."""
    rows, names, schema = _columns(docs, keep, text, "text")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file
    tail = array("i", [vocabulary.end] if end else []).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in slices(batches):
            out = [encoder.encode(t) + tail if t else tail for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, out)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], ids], [*names, "ids"])

    return rows.mapInArrow(task, schema + "ids array<int>").select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "ids")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with `decoded`, the text of every row's ids."""
    own, names, schema = _columns(rows, keep, ids, "ids")
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in slices(batches, "ids"):
            texts = [decoder.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return own.mapInArrow(task, schema + "decoded string").select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "decoded")
