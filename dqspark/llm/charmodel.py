"""Counts of character n-grams over a corpus: classes of bytes, one table of fixed size.

A model's cells are bounded by classes ** order whatever the corpus is, so the
summed table may be held and sent whole.  Every task counts all of its texts and
hands on the cells that occur; Spark sums them by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import steps


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the bounds of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def padded(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the bytes with ``pad`` zeros (class 0, a break) before every row, and where rows begin."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    begin = bounds[:-1] + pad * np.arange(1, n + 1)
    out = np.zeros(len(data) + pad * n, table.dtype)
    out[np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), size)] = table[data]
    return out, begin


def codes(classes: np.ndarray, order: int, n_classes: int) -> np.ndarray:
    """Cell of the n-gram that ends at each place from order - 1 on."""
    if len(classes) < order:
        return np.zeros(0, np.int64)
    total = len(classes) - order + 1
    out = np.zeros(total, np.int64)
    for i in range(order):
        out *= n_classes
        out += classes[i : i + total]
    return out


def count_cells(texts: DataFrame, table: np.ndarray, order: int, n_classes: int) -> DataFrame:
    """(cell, n) of every n-gram cell of ``texts`` (text) that occurs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes**order, np.int64)
        for batch in steps(parts, size=1_000_000):
            classes, _ = padded(*raw(batch.column("text")), table, order - 1)
            found = codes(classes, order, n_classes)
            if len(found):
                total += np.bincount(found, minlength=len(total))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    return texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, size: int) -> np.ndarray:
    """The summed cells as one array; at most ``size`` rows come to the driver."""
    got = counts.select("cell", "n").toPandas()
    out = np.zeros(size, np.float64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def kneser_ney(counts: np.ndarray, order: int, n_classes: int) -> np.ndarray:
    """Interpolated modified Kneser-Ney probabilities of all cells, from the counts of the highest order.

    Lower orders count the distinct continuations; three discounts an order come
    from the counts of counts.  Contexts that were never seen take the lower
    order as it is.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):
        above = levels[-1].reshape(n_classes, -1)
        levels.append((above > 0).sum(0).astype(np.float64))
    p = np.full(1, 1.0 / n_classes)
    for c in reversed(levels):
        c = c.reshape(-1, n_classes)
        n = [float(np.count_nonzero(c == i)) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        off = [0.0] + [
            min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5 for i in range(1, 4)
        ]
        discount = np.choose(np.minimum(c, 3).astype(np.int64), off)
        total = c.sum(1, keepdims=True)
        seen = np.maximum(total, 1)
        spare = np.where(total > 0, discount.sum(1, keepdims=True) / seen, 1.0)
        lower = p.reshape(-1, n_classes) if p.size > 1 else np.full((1, n_classes), p[0])
        # the context without its first class names the row of the lower order
        below = lower[np.arange(c.shape[0]) % lower.shape[0]]
        p = ((c - discount) / seen + spare * below).reshape(-1)
    return p
