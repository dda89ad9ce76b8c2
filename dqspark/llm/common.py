"""Helpers the operators share: words, hashes of words in whole batches, folders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.session import new_folder

#: Words of most contracts: everything but space, tab, and the line and page breaks.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one step works on inside a task, whatever the size of a batch.
STEP_BYTES = 4_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only, as the contracts ask; ``lower`` would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, pattern: str = SPACES) -> Column:
    """Words between separators; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def count_words(text: Column) -> Column:
    """Number of words without an array of them being filtered."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder or new_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside drop their shuffle files when they end, not when the driver's memory is next cleared.

    Results to be read again must be stored.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of a batch that goes to Python: texts are long, and a batch is held whole."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a step holds a bounded number of text bytes (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum([0 if n is None else n for n in _lengths(batch.column(column))])
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


#: Bytes of text up to which hashes come from running sums.
_SUM_BYTES = 600_000


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of hashes, from the first on, and those of its inverse (modulo 2^64), from the zeroth on."""
    power = np.cumprod(np.full(_SUM_BYTES, _BASE, np.uint64), dtype=np.uint64)
    inverse = np.full(_SUM_BYTES, pow(int(_BASE), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return power, np.cumprod(inverse, dtype=np.uint64)


class Words:
    """The words of a column of texts: where they start and end, whose they are."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[
            bounds[0] if n else 0 : bounds[-1] if n else 0
        ]
        self.bounds = bounds - (bounds[0] if n else 0)
        solid = ~_IS_SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        first[inner] = solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.per_row = np.diff(np.searchsorted(self.start, self.bounds)) if n else np.zeros(0, np.int64)
        self.row_first = np.concatenate(([0], np.cumsum(self.per_row)))

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.per_row)), self.per_row)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; A-Z lower-cased if asked."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.repeat(self.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        place = at - np.repeat(self.start, size)
        power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
        table = _BYTE[_LOWER] if lower else _BYTE
        value = table[self.data[at]] * power[place]
        return mix(np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1]))) + size.astype(np.uint64))

    def hashes_by_sums(self) -> np.ndarray:
        """The same as ``hashes``, by differences of running sums: quicker where the text is short enough."""
        if len(self.data) > _SUM_BYTES or not len(self.start):
            return self.hashes()
        power, inverse = _powers()
        upto = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=upto[1:])
        return mix((upto[self.end] - upto[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def of_row(self, i: int) -> list[bytes]:
        """The words of one row; ``bytes.split`` parts at the same six separators."""
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes().split()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (runs over row ends included)."""
    total = max(0, len(hashes) - n + 1)
    out = np.zeros(total, np.uint64)
    for i in range(n):
        out = out * _TURN + hashes[i : i + total]
    return mix(out)


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one behind another in ``data`` (bytes), with their ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())
