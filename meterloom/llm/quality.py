"""Quality classifier: logistic regression over hashed word n-grams, fitted with FTRL updates.

Features are the words and word pairs of the text, hashed into 2**bits buckets. Runs of letters and
digits and runs of other signs are words of their own; a pair of equal words, whichever, shares one
bucket, and so do all words in capitals. A score is the logistic of a sparse dot product divided by the root of the number of features.
Follow-the-regularised-leader updates run one labelled text at a time. They are fitted on at most
`bound` labelled rows (those with the smallest hash of the id; every labelled row if there are
fewer); the model is one array of fixed size. Scoring covers every row and its whole text.

Defined results: null and empty texts have no feature and score by the bias alone; with nothing to
learn from every score is 0.5. Labels other than 0 and 1 are not learned from. Repeated rows repeat
their score. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+").findall
BITS = 18
BOUND = 16_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all words and word pairs, with repeats."""
    words = _WORDS(text.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1 << 32)
    pairs = np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(3))
    caps = np.full(sum(len(w) > 1 and w.isupper() for w in words), 2, np.uint64)
    return ((np.concatenate((h, pairs, caps)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def score(text: str, model: Model) -> float:
    x = features(text, model.bits)
    z = model.bias + (float(model.weights[x].sum()) / len(x) ** 0.5 if len(x) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_ftrl(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, passes: int = 3) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows of (buckets, label) in the order given; the last slot is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    packed = []
    for x, y in rows:
        u, c = np.unique(x, return_counts=True)
        packed.append((np.append(u, size - 1), np.append(c / max(1, len(x)) ** 0.5, 1.0), y))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(passes):
        for i, v, y in packed:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(float(w @ v), -30, 30))) - y) * v
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[i] = more
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def train(rows: DataFrame, bits: int = BITS, bound: int = BOUND, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """Fit on the labelled rows; one task runs the updates, over `bound` rows at most."""
    few = rows.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    few = few.withColumn("h", F.xxhash64("k", "y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(features(t, bits), y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist())]
        if rows:
            w, bias = fit_ftrl(rows[:bound], bits)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["w", "bias"])

    got = few.repartition(1).sortWithinPartitions("h", "k", "y", "text").select("text", "y").mapInArrow(task, "w binary, bias double").collect()
    return Model(np.frombuffer(got[0].w, np.float32), got[0].bias, bits) if got else Model(np.zeros(1 << bits, np.float32), 0.0, bits)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = BOUND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most `bound` labelled rows, by the smallest hash of the id; ids are picked before texts are touched."""
    ids = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("label")).filter(F.col("k").isNotNull() & F.col("label").isin(0, 1))
    ids = ids.orderBy(F.xxhash64("k"), "k", "label").limit(bound)
    texts = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text"))
    return texts.join(F.broadcast(ids), "k").select(F.col("k").alias("doc_id"), "text", "label")  # `bound` ids of 12 bytes


def score_rows(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` with `score` for every row, from its whole text."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = [score(t or "", sent.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(said, pa.float64())], [*names, "score"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "score double"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "score")
