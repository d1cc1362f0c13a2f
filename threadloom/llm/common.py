"""Helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, other bytes as they are.
LOWERED = bytes.maketrans(UPPER, LOWER)
ASCII_SPACE = b" \t\n\r\x0b\x0c"

#: Texts that one step of a task holds as Python objects.
SLICE_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Memo(dict):
    """Values of ``make`` by key; it starts afresh at ``limit`` keys, and long keys are not kept.

    What it holds is a copy of what ``make`` would return, so its size changes speed only.
    """

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is an empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict]], schema: str, text: str, keep: str) -> DataFrame:
    """``keep`` and the columns that a function makes of a list of texts.

    ``make`` runs once a task and returns that function; ``schema`` lists the
    columns it returns by name.
    """
    kept = df.select(df[keep], df[text].alias("_text"))
    kind = kept.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            out = work(texts(batch, "_text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], [keep, *out])

    return kept.mapInArrow(run, f"`{keep}` {kind}, {schema}")


#: Largest bit map that goes to every task, in bits (32 MB).
MOST_BITS = 1 << 28


def bit_map(df: DataFrame, column: str) -> np.ndarray:
    """Bit map of a column of hashes: 16 bits or more for each of its rows, up to ``MOST_BITS`` in all.

    It lets through every hash of the column and some others, the more the
    fuller it is.  So it may only save work before a join that settles the
    matter: beyond some ten million rows it saves less and less.
    """
    bits = 1 << 15
    rows = df.count()
    while bits < 16 * rows and bits < MOST_BITS:
        bits *= 2
    spot = F.pmod(F.col(column), F.lit(bits)) + 1
    parts = df.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    found = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # bits / 8 bytes
        found[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return found


def passes(df: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """Tells tasks which hashes the bit map of a column lets through."""
    shared = df.sparkSession.sparkContext.broadcast(bit_map(df, column))

    def known(hashes: np.ndarray) -> np.ndarray:
        bitmap = shared.value
        bits = np.uint64(8 * len(bitmap))
        spot = hashes.view(np.uint64) % bits
        return (bitmap[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return known
