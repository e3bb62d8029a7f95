"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def held_out(doc_id: Column, n: int, left: int) -> Column:
    """Whether the id belongs to the part that is never learned from; a null id does not."""
    return F.coalesce(remainder(doc_id, n) == left, F.lit(False))


def learned(doc_id: Column, n: int, left: int) -> Column:
    """Whether the id may be learned from; a null id may not."""
    return F.coalesce(remainder(doc_id, n) != left, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20, packs: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text, whatever the texts' lengths; of `packs`, once unpacked."""
    for batch in batches:
        col = batch.column(column)
        if not len(batch) or col.nbytes <= most and not packs:
            yield batch
            continue
        start, size = 0, 0
        listed = pa.types.is_list(col.type)
        sizes = [x and int.from_bytes(x[:8], "little") for x in col.to_pylist()] if packs else (pc.list_value_length if listed else pc.binary_length)(col).to_pylist()
        for i, n in enumerate(sizes):
            size += (n or 0) * (4 if listed else 1)
            if size > most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(batch):
            yield batch.slice(start)


def apart(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], str]:
    """The rows under column names c0, c1, ... that no operator uses, those names, and that of `text`."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def pack(x: bytes) -> bytes:
    """Zstandard, after eight bytes with the length; `unpack` undoes it."""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows with a text column as `pack` makes it (UTF-8; null stays null), for shuffles of whole texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array([None if x is None else pack(x) for x in texts], pa.binary()))

    return df.mapInArrow(task, StructType([StructField(f.name, BinaryType(), True) if f.name == column else f for f in df.schema]))
