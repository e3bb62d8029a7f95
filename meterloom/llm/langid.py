"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent letter n-grams (one to three letters of
words padded by a blank, lower-cased) in rank order. A document is compared with every profile by
the out-of-place distance: the sum, over the document's own most frequent n-grams, of how far
their rank there is from their rank in the profile; an n-gram that the profile lacks counts as
`top` places. The nearest profile wins, ties go to the alphabetically first label.

Defined results: null text, empty text and text without a letter give `und` with score 0; with
no profile at all (nothing to learn from) every row gives `und`. Rows are judged one by one, so
repeated rows repeat their result; null labels and null texts are not learned from. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import apart, slices

TOP = 300
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_codes(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the n-grams of all texts as integers (21 bits a letter) and where each text starts."""
    lows = [t.lower() for t in texts]
    lens = np.fromiter(map(len, lows), np.int64, len(lows)) + 2
    points = np.frombuffer((" " + "  ".join(lows) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    first = np.zeros(len(points), bool)
    first[np.cumsum(lens) - lens] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    sym = np.where(letter, points, 32).astype(np.int64)[keep]
    owner = np.repeat(np.arange(len(lows)), lens)[keep]
    is_letter = letter[keep]
    out = []
    for n in (1, 2, 3):
        if n == 1:
            ok, code, who = is_letter, sym, owner
        elif n == 2:
            ok = (owner[:-1] == owner[1:]) & (is_letter[:-1] | is_letter[1:])
            code, who = (sym[:-1] << 21) | sym[1:], owner[1:]
        else:
            ok = (owner[:-2] == owner[2:]) & is_letter[1:-1]
            code, who = (sym[:-2] << 42) | (sym[1:-1] << 21) | sym[2:], owner[2:]
        out.append((code[ok], np.searchsorted(who[ok], np.arange(len(lows) + 1))))
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[edge], np.diff(np.append(edge, len(codes)))


def top_grams(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams in rank order; equal counts rank by code."""
    if not len(codes):
        return codes
    grams, n = _counted(codes)
    return grams[np.argsort(-n, kind="stable")[:top]]


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for label, parts in held.items():
            codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            grams, at = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams)), pa.array(grams), pa.array(np.bincount(at, n, len(grams)).astype(np.int64))], ["label", "gram", "n"])
        held.clear()

    for batch in slices(batches):
        labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
        for label in dict.fromkeys(labels):
            grams = gram_codes([t for t, x in zip(texts, labels) if x == label])
            counted = _counted(np.concatenate([g[0] for g in grams])) if any(len(g[0]) for g in grams) else None
            if counted:
                held.setdefault(label, []).append(counted)
                size += len(counted[0])
        if size > 1_000_000:
            yield from flush()
            size = 0
    yield from flush()


def learn_profiles(docs: DataFrame, text: str = "text", label: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from every row with a text and a label.

    Counting is a partial sum in each task and a grouped sum in Spark; what reaches the driver is
    `top` n-grams for each label.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).dropna()
    counts = rows.mapInArrow(_count_task, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= top).select("label", "gram", "rank").collect()
    out: dict[str, np.ndarray] = {}
    for x in sorted(best, key=lambda x: (x.label, x.rank)):
        out.setdefault(x.label, []).append(x.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def rank_table(profiles: dict[str, np.ndarray], top: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, all profile n-grams in ascending order, and their rank in each profile (`top`: absent)."""
    labels = sorted(profiles)
    grams = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
    ranks = np.full((len(grams) + 1, len(labels)), top, np.int32)
    for j, label in enumerate(labels):
        ranks[np.searchsorted(grams, profiles[label]), j] = np.arange(len(profiles[label]))
    return labels, grams, ranks


def nearest(best: np.ndarray, labels: list[str], grams: np.ndarray, ranks: np.ndarray, top: int) -> tuple[str, float]:
    """The label whose profile is nearest to ranked n-grams, and 1 less the share of the largest distance."""
    if not len(best) or not labels:
        return UNKNOWN, 0.0
    at = np.searchsorted(grams, best)
    at[at == len(grams)] = 0
    at = np.where(grams[at] == best, at, len(grams))
    table = ranks[at]
    away = np.where(table == top, top, np.abs(table - np.arange(len(best))[:, None])).sum(axis=0)
    j = int(away.argmin())
    return labels[j], float(1 - away[j] / (top * len(best)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int = TOP) -> DataFrame:
    """The columns of `keep` with `lang_pred` and `lang_score` for every row, from its whole text."""
    labels, grams, ranks = rank_table(profiles, top)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            (a, at), (b, bt), (c, ct) = gram_codes([t or "" for t in batch.column("text").to_pylist()])
            said = [nearest(top_grams(np.concatenate((a[at[i]:at[i + 1]], b[bt[i]:bt[i + 1]], c[ct[i]:ct[i + 1]])), top), labels, grams, ranks, top) if at[i] < at[i + 1] else (UNKNOWN, 0.0) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*names, "lang_pred", "lang_score"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "lang_pred string", "lang_score double"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "lang_score")


def reject_unknown(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """The rows of documents whose language can be told; those that give `und` go."""
    own, names, text = apart(docs)
    return identify(own, profiles, text, names, top).filter(F.col("lang_pred") != UNKNOWN).select(*names).toDF(*docs.columns)
