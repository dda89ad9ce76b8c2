"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

Components become integers, so that all distances, means and ties are exact.  A
part lies in a coarse cell of a grid.  For a cell, the entries whose least
distance to its box exceeds the smallest greatest distance of any entry can be
nearest to no point of it; the others are remembered under the cell, and only
these are evaluated for the parts that fall into it.  Codebooks are fitted by
rounds of assignment and floored means; the sums of a round are combined in the
tasks and by a group-by, so the driver sees one codebook a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import store

#: Cells a task remembers for a part before it begins anew; forgotten ones are computed again.
REMEMBERED = 100_000
#: Vectors a step works on.
STEP_ROWS = 4096
_LONG = 2**63
_FAR = np.iinfo(np.int64).max


class Grid:
    """Codebooks with the cells of each part that were met so far."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.width = books.shape
        spread = books.max(axis=1) - books.min(axis=1) if books.size else np.zeros((self.parts, 1), int)
        # about an eighth of the spread of the entries, as a power of two
        self.shift = [max(0, int(np.sort(row)[len(row) // 2]).bit_length() - 3) if len(row) else 0 for row in spread]
        self.known: list[dict] = [{} for _ in range(self.parts)]
        self.evaluated = self.possible = 0

    def candidates(self, part: int, cells: np.ndarray) -> np.ndarray:
        """Which entries no other one dominates across the box of a cell, per cell."""
        side = 1 << self.shift[part]
        low = (cells * side)[:, None, :]
        book = self.books[part].astype(low.dtype)[None, :, :]
        above, below = book - (low + (side - 1)), low - book
        nearest = np.maximum(np.maximum(above, below), 0)
        farthest = np.maximum(above + (side - 1), below + (side - 1))
        least = (nearest * nearest).sum(axis=2)
        most = (farthest * farthest).sum(axis=2)
        return least <= most.min(axis=1)[:, None]

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the lowest of equals) and squared distance of every part of integer vectors."""
        n = len(values)
        codes = np.zeros((n, self.parts), np.int64)
        error = np.zeros((n, self.parts), values.dtype)
        if not self.width or not n:
            return codes, error
        cut = values.reshape(n, self.parts, self.width)
        for part in range(self.parts):
            x = cut[:, part, :]
            mask = self._masks(part, x >> self.shift[part])
            row, entry = np.nonzero(mask)
            away = x[row] - self.books[part].astype(x.dtype)[entry]
            distance = np.full((n, self.entries), _FAR if x.dtype != object else float("inf"), x.dtype)
            distance[row, entry] = (away * away).sum(axis=1)
            codes[:, part] = distance.argmin(axis=1)
            error[:, part] = distance[np.arange(n), codes[:, part]]
            self.evaluated += len(row)
            self.possible += mask.size
        return codes, error

    def _masks(self, part: int, cells: np.ndarray) -> np.ndarray:
        known = self.known[part]
        if cells.dtype == object:
            keys = [tuple(c) for c in cells.tolist()]
            first = list({k: i for i, k in reversed(list(enumerate(keys)))}.items())
            order = {k: i for i, (k, _) in enumerate(first)}
            places = np.array([i for _, i in first])
            inverse = np.array([order[k] for k in keys])
        else:
            cells = np.ascontiguousarray(cells)
            whole = cells.view(np.dtype((np.void, cells.itemsize * self.width))).ravel()
            found, places, inverse = np.unique(whole, return_index=True, return_inverse=True)
            first = [(v.tobytes(), i) for v, i in zip(found, places)]
        out = np.zeros((len(first), self.entries), bool)
        missing = []
        for i, (key, _) in enumerate(first):
            mask = known.get(key)
            if mask is None:
                missing.append(i)
            else:
                out[i] = mask
        if missing:
            out[missing] = self.candidates(part, cells[places[missing]])
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
            known.update((first[i][0], out[i].copy()) for i in missing)
        return out[inverse.ravel()]


def _integers(column: pa.Array, scale: int, dim: int, books_bound: int = 0) -> np.ndarray:
    """floor(scale * x) of vectors of one length; Python integers where a distance might not fit into 64 bits."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * float(scale))
    reach = max(float(np.abs(scaled).max()) if scaled.size else 0.0, float(books_bound))
    if (4 * reach + 4) ** 2 * max(dim, 1) < _LONG:
        return scaled.astype(np.int64)
    # the product is taken in integers, as it may exceed what a double holds
    whole = [[(int(p) * scale) // int(q) for p, q in (float(x).as_integer_ratio() for x in row)] for row in flat]
    return np.array(whole, dtype=object).reshape(len(column), dim)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def _bound(books: np.ndarray) -> int:
    return max((abs(int(x)) for x in books.ravel()), default=0)


def _kept(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """Ids, labels and vectors whose components are all there and finite, as doubles."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & finite).select(
        F.col(id_column).alias("id"), F.col(label).alias("label"), x.cast("array<double>").alias("vector")
    )


def _first_book(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; the first of them gives the length."""
    order = [F.col("id").asc_nulls_last(), "vector"]
    head = kept.select("id", "vector").orderBy(*order).limit(1).collect()
    if not head:
        return None
    dim = len(head[0]["vector"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    rows = kept.where(F.size("vector") == dim).orderBy(*order).select("vector").limit(entries).collect()
    values = _integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), scale, dim)
    return values.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy()


def _next_book(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: assign all parts, then floored means of the parts of each entry; unused entries stay."""
    parts, entries, width = books.shape
    bound = _bound(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(books)
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for batch in _steps(batches):
            values = _integers(batch.column("vector"), scale, parts * width, bound)
            codes, _ = grid.assign(values)
            cut = values.reshape(len(values), parts, width)
            for part in range(parts):
                member = codes[:, part][None, :] == np.arange(entries)[:, None]
                count[part] += member.sum(axis=1)
                total[part] = total[part] + member.astype(values.dtype) @ cut[:, part, :]
        part, entry, place = (x.ravel() for x in np.indices((parts, entries, width)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                pa.array(np.repeat(count.ravel(), width), pa.int64()),
                pa.array([Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0)),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    schema = "part int, entry int, place int, n long, total decimal(38,0)"
    rows = (
        kept.select("vector").mapInArrow(sums, schema).groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    )
    after = books.astype(object)
    for r in rows:
        if r["n"]:
            after[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return after if _bound(after) >= 2**62 else after.astype(np.int64)


def fit(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray | None:
    """Codebooks (part, entry, place) of stored vectors (``id``, ``vector``); None without vectors."""
    books = _first_book(kept, parts, entries, scale)
    if books is None or not books.size:
        return books
    alike = kept.where(F.size("vector") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        after = _next_book(alike, books, scale)
        if np.array_equal(after, books):  # all later rounds would repeat this one
            break
        books = after
    return books


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(str(int(x)) for x in books.ravel())


def encode(kept: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits a part) and ``error`` of stored vectors.

    Vectors of another length than the codebooks have no code and no error.  An
    error beyond a 64-bit integer ends the job with a message.
    """
    parts, _, width = books.shape
    bound = _bound(books)
    names = [f.name for f in kept.schema.fields if f.name != "vector"]

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(books)
        for batch in _steps(batches):
            codes, error = grid.assign(_integers(batch.column("vector"), scale, parts * width, bound))
            sums = error.sum(axis=1)
            if len(sums) and max(sums.tolist()) >= _LONG:
                raise OverflowError("the squared distance of a vector exceeds a 64-bit integer")
            texts = [row.astype(np.uint8).tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(sums.tolist(), pa.int64())],
                [*names, "code", "error"],
            )

    fits = F.size("vector") == parts * width
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "vector")
    coded = kept.where(fits).mapInArrow(codes_of, f"{schema}, code string, error long")
    others = kept.where(~fits).select(
        *names, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    return coded.unionByName(others)


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> DataFrame:
    """Code, error, error of all rows of the same label, and digest of the codebooks, per vector.

    Vectors that are null or hold null, NaN or infinite components give no row.
    Codebooks begin with the vectors of the smallest ids (those without an id
    last, equal ids by their vectors); with fewer than ``entries`` vectors they
    have as many entries.  Repeated rows count and are returned repeatedly.
    Labels may be null (one group).  Vectors of another length than that of the
    smallest id get a null code and error.  Other columns are not read.  Without
    vectors the result is empty.
    """
    kept = store(_kept(vectors, id_column, vector, label))
    books = fit(kept, parts, entries, rounds, scale)
    names = [F.col("id").alias(id_column), "code", "error"]
    if books is None:
        none = kept.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
        return none.select(*names, F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    coded = store(encode(kept, books, scale))
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    )
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select(*names, "label_error", F.lit(digest).alias("codebooks_sha256"))
