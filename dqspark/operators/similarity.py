"""Best stored entry for a query vector, by cosine similarity.

Exact at every size and without a cross join:

* one side is small (checked): it is sent to every task as a matrix, the other
  side streams past it and keeps the best entry per query;
* both sides are large and lie in clusters: vectors of length one at distance
  r = sqrt(2 - 2 t) or less have a similarity of t or more.  Entries belong to
  the cell of their nearest pivot; a query visits each cell that can hold an
  entry within r.  Cells are joined by equality, and large cells are split on
  both sides;
* both sides are large and spread evenly, so that a query would visit most
  cells: packed blocks of queries meet packed blocks of entries, once per pair of
  blocks.  Vectors are rotated to the principal directions of a sample; the
  product of two vectors is at most the product of their first coordinates plus
  the product of the lengths of the rest, and only pairs whose bound reaches the
  limit (or the best so far) are evaluated.  A few blocks are copied to each
  other; many are stored once by a shuffle, and each pair of parts reads its two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.operators.columns import col
from dqspark.operators.sample import random_order

#: Bytes of vectors that may be sent to every task.
SMALL_BYTES = 32 << 20
SMALL_SIDE = 4096
PIVOTS = 256
CELL_ROWS = 20_000
PRODUCT_CELLS = 4_000_000  # size of one matrix product in a task
BOUND_CELLS = 1 << 20  # the same for bounds, all of which may have to be evaluated
EVALUATED_PAIRS = 20_000  # pairs evaluated at once
ROUNDING = 1e-9
#: Copies of a vector, on average, beyond which neither cells nor copied blocks are used.
MOST_VISITS = 16
MOST_COPIES = 4
#: Copies of vectors that leave a batch at once; parts of either side, at least, if there are as many blocks.
COPIED_ROWS = 20_000
PAIRED_PARTS = 8
#: Bytes of vectors in a block of either side, rows of a packed piece of one, rows looked at to choose between the ways.
BLOCK_BYTES = 16 << 20
PIECE_ROWS = 1000
LOOK_ROWS = 4096
#: How far below the limit the rests of two usual vectors may stay once their first coordinates are known.
REST_MARGIN = 0.25


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero and is like nothing."""
    if not len(vectors):
        return np.zeros((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(query_keys, queries, entry_keys, entries, threshold, skip_same) -> pd.DataFrame:
    """Best entry per query among the given ones; the lowest key on ties."""
    if not len(query_keys) or not len(entry_keys):
        return pd.DataFrame({"q": query_keys[:0], "e": entry_keys[:0], "s": np.zeros(0)})
    order = np.argsort(entry_keys, kind="stable")
    entry_keys, entries = entry_keys[order], entries[order]
    at, score = np.empty(len(query_keys), dtype=np.int64), np.empty(len(query_keys))
    rows = max(1, PRODUCT_CELLS // len(entry_keys))
    for start in range(0, len(query_keys), rows):
        part = slice(start, start + rows)
        like = queries[part] @ entries.T
        if skip_same:
            like[query_keys[part, None] == entry_keys[None, :]] = -np.inf
        at[part] = like.argmax(axis=1)
        score[part] = like[np.arange(len(like)), at[part]]
    keep = (score >= threshold) & (score > 0)
    return pd.DataFrame({"q": query_keys[keep], "e": entry_keys[at[keep]], "s": score[keep]})


def best_match(
    queries: DataFrame,
    entries: DataFrame,
    query_key: str,
    entry_key: str,
    query_vector: str,
    entry_vector: str,
    min_similarity: float = V.MIN_SIMILARITY,
    skip_same_key: bool = False,
    small_side: int = SMALL_SIDE,
    pivots: int = PIVOTS,
    cell_rows: int = CELL_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each query its most similar entry at ``min_similarity`` or above.

    Result: (query_key, entry_key, similarity); queries without such an entry
    are left out; a key with several query rows has the best match of them all.
    Vectors are taken as they are, of equal length.  Scores must
    be positive, as the reference point of the search is 0.
    """
    q = queries.select(col(query_key).alias("q"), col(query_vector).alias("v")).where("q IS NOT NULL AND v IS NOT NULL")
    e = entries.select(col(entry_key).alias("e"), col(entry_vector).alias("v")).where("e IS NOT NULL AND v IS NOT NULL")
    types = f"q {q.schema['q'].dataType.simpleString()}, e {e.schema['e'].dataType.simpleString()}, s double"
    # a side is small if its vectors fit the number of rows and SMALL_BYTES together
    width = e.select(F.size("v")).first()
    small_side = min(small_side, SMALL_BYTES // (8 * max(1, width[0] if width else 1)))
    few_entries = e.limit(small_side + 1).toPandas()
    if len(few_entries) <= small_side:
        parts = _against_entries(q, few_entries, types, min_similarity, skip_same_key)
    else:
        few_queries = q.limit(small_side + 1).toPandas()
        if len(few_queries) <= small_side:
            parts = _against_queries(e, few_queries, types, min_similarity, skip_same_key)
        else:
            parts = _large_sides(q, e, types, min_similarity, skip_same_key, pivots, cell_rows, block_bytes)
    # one row per query key, whichever way was taken
    best = F.struct(-F.col("s"), F.col("e"))
    found = parts.groupBy("q").agg(F.min_by(F.struct("e", "s"), best).alias("b")).select("q", "b.e", "b.s")
    return found.select(
        F.col("q").alias(query_key),
        F.col("e").alias(entry_key if entry_key != query_key else f"similar_{entry_key}"),
        F.col("s").alias("similarity"),
    )


def _against_entries(q: DataFrame, rows: pd.DataFrame, types: str, threshold: float, skip_same: bool) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast((rows["e"].to_numpy(), unit_rows(rows["v"])))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, matrix = shared.value
        for batch in batches:
            yield _best(batch["q"].to_numpy(), unit_rows(batch["v"]), keys, matrix, threshold, skip_same)

    return q.mapInPandas(look_up, types)


def _against_queries(e: DataFrame, rows: pd.DataFrame, types: str, threshold: float, skip_same: bool) -> DataFrame:
    shared = e.sparkSession.sparkContext.broadcast((rows["q"].to_numpy(), unit_rows(rows["v"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, matrix = shared.value
        best = None
        for batch in batches:
            new = _best(keys, matrix, batch["e"].to_numpy(), unit_rows(batch["v"]), threshold, skip_same)
            both = new if best is None else pd.concat([best, new])
            best = both.sort_values(["q", "s", "e"], ascending=[True, False, True]).drop_duplicates("q")
        if best is not None:
            yield best

    return e.mapInPandas(scan, types)


def _large_sides(
    q: DataFrame, e: DataFrame, types: str, threshold: float, skip_same: bool, n_pivots: int, cell_rows: int, block_bytes: int
) -> DataFrame:
    """Cells or blocks, whichever makes fewer copies of vectors; pairs of stored blocks where both make many."""
    looked = unit_rows(q.orderBy(random_order(["q"], 0)).limit(LOOK_ROWS).toPandas()["v"])
    sample = unit_rows(e.orderBy(random_order(["e"], 0)).limit(max(LOOK_ROWS, n_pivots)).toPandas()["v"])
    rows = max(1, block_bytes // (8 * max(1, sample.shape[1])))
    n_q, n_e = q.count(), e.count()
    blocks_q, blocks_e = math.ceil(n_q / rows), math.ceil(n_e / rows)
    pivots = sample[:n_pivots]
    visits = float(_visited(looked, pivots, threshold).sum(axis=1).mean()) if len(looked) else 0.0
    if visits <= MOST_VISITS and n_q * (visits - 1) <= n_q * (blocks_e - 1) + n_e * (blocks_q - 1):
        return _by_cells(q, e, types, threshold, skip_same, n_pivots, cell_rows)
    directions = principal(sample, threshold)
    if max(blocks_q, blocks_e) <= MOST_COPIES:
        return _by_blocks(q, e, types, threshold, skip_same, directions, blocks_q, blocks_e)
    return _by_pairs(q, e, types, threshold, skip_same, directions, blocks_q, blocks_e, rows, block_bytes)


def _visited(units: np.ndarray, pivots: np.ndarray, threshold: float) -> np.ndarray:
    """Cells that may hold an entry similar to each vector."""
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + ROUNDING
    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ pivots.T))
    return d <= d.min(axis=1, keepdims=True) + 2 * radius + ROUNDING


def principal(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The principal directions that are compared first, as columns.

    Any directions at right angles give right bounds; those of a sample gather
    most of the lengths.  As many are taken as leave rests whose product stays
    clearly below the limit.
    """
    if not sample.size:
        return np.zeros((sample.shape[1] if sample.ndim == 2 else 0, 0))
    _, directions = np.linalg.eigh(sample.T @ sample)
    directions = directions[:, ::-1]
    rest = 1.0 - np.cumsum(((sample @ directions) ** 2).mean(axis=0))
    k = int(np.searchsorted(-rest, -max(threshold - REST_MARGIN, 0.0)) + 1)
    return np.ascontiguousarray(directions[:, : min(k, directions.shape[1])])


def _packed(df: DataFrame, key: str, kind: str, rows: int) -> DataFrame:
    """Pieces of at most ``rows`` vectors, scaled to length one; zero vectors are like nothing and left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                piece = batch.iloc[start : start + rows]
                units = unit_rows(piece["v"])
                live = np.flatnonzero(units.any(axis=1))
                if len(live):
                    keys = piece[key].to_numpy()[live]
                    yield pd.DataFrame({"keys": [keys], "data": [units[live].tobytes()]})

    return df.mapInPandas(pack, f"keys array<{kind}>, data binary")


def _by_blocks(
    q: DataFrame, e: DataFrame, types: str, threshold: float, skip_same: bool, directions: np.ndarray, blocks_q: int, blocks_e: int
) -> DataFrame:
    """Every block of queries against every block of entries; a vector is copied once per block of the other side."""
    q_type, e_type = (t.split(" ", 1)[1] for t in types.split(", ")[:2])

    def packed(df: DataFrame, key: str, kind: str, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        dealt = _packed(df, key, kind, PIECE_ROWS).withColumn(own_name, F.pmod(F.xxhash64("data"), F.lit(own)).cast("int"))
        return dealt.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def unpacked(pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.asarray(k) for k in pieces["keys"]]) if len(pieces) else np.zeros(0)
        data = np.concatenate([np.frombuffer(d) for d in pieces["data"]]) if len(pieces) else np.zeros(0)
        return keys, data.reshape(len(keys), -1) if len(keys) else np.zeros((0, 0))

    def compare(qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        return bounded_best(*unpacked(qs), *unpacked(es), threshold, skip_same, directions)[0]

    by = ["block_q", "block_e"]
    left = packed(q, "q", q_type, blocks_q, blocks_e, "block_q", "block_e")
    right = packed(e, "e", e_type, blocks_e, blocks_q, "block_e", "block_q")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, types)


def _by_pairs(
    q: DataFrame, e: DataFrame, types: str, threshold: float, skip_same: bool, directions: np.ndarray, blocks_q: int, blocks_e: int,
    rows: int, block_bytes: int,
) -> DataFrame:
    """Every block of queries against every block of entries, none copied: both sides lie in a shuffle in parts of
    about ``BLOCK_BYTES``, and a task reads a part of either side.  It holds the part of the entries and sees the
    queries block by block, each with all entries of the part in turn, so that a query keeps one best of them."""
    q_type, e_type = (t.split(" ", 1)[1] for t in types.split(", ")[:2])

    def packed(df: DataFrame, key: str, kind: str, blocks: int) -> DataFrame:
        parts = min(blocks, max(PAIRED_PARTS, -(-blocks * block_bytes // BLOCK_BYTES)))
        # dealt twice: as rows, so that blocks are full whatever the input's parts, and as blocks, so that no pair packs anew
        pieces = _packed(df.repartition(parts), key, kind, rows).repartition(parts)
        return pieces.withColumnsRenamed({"keys": f"keys_{key}", "data": f"block_{key}"})

    def matrix(keys: np.ndarray, data: bytes) -> np.ndarray:
        return np.frombuffer(data).reshape(len(keys), -1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, keys, block = None, None, None
        for batch in batches:
            for keys_q, block_q, keys_e, block_e in zip(*(batch[c] for c in ("keys_q", "block_q", "keys_e", "block_e")), strict=True):
                if best is None or block_q != block or not np.array_equal(keys_q, keys):
                    if best is not None:
                        yield best.found()
                    keys, block = np.asarray(keys_q), block_q
                    best = BoundedBest(keys, matrix(keys, block), threshold, skip_same, directions)
                best.see(np.asarray(keys_e), matrix(keys_e, block_e))
        if best is not None:
            yield best.found()

    left, right = packed(q, "q", q_type, blocks_q), packed(e, "e", e_type, blocks_e)
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInPandas(compare, types)


class BoundedBest:
    """The best entry of each query of a block, among the entries seen so far; the lowest key on ties.

    Queries and entries have length one.  Bounds are products in single precision,
    lowered by what that can be off; scores are computed in double precision.
    """

    def __init__(self, query_keys, queries, threshold: float, skip_same: bool, directions: np.ndarray):
        self.keys, self.queries, self.directions = query_keys, queries, directions
        self.threshold, self.skip_same = threshold, skip_same
        self.cuts = self._cut(queries)
        self.slack = ROUNDING + (self.cuts.shape[1] + 4) * 2.0**-23
        self.score = np.full(len(query_keys), -np.inf)
        self.entry = None

    def _cut(self, m: np.ndarray) -> np.ndarray:
        """First coordinates, and behind them the length of the rest."""
        first = m @ self.directions
        rest = np.sqrt(np.maximum(0.0, (m * m).sum(axis=1) - (first * first).sum(axis=1)))
        return np.column_stack([first, rest]).astype(np.float32)

    def see(self, entry_keys, entries) -> int:
        """Take in more entries; the number of pairs that had to be evaluated."""
        order = np.argsort(entry_keys, kind="stable")
        entry_keys, entries = entry_keys[order], entries[order]
        if self.entry is None:
            self.entry = np.empty(len(self.keys), dtype=entry_keys.dtype)
        cuts = self._cut(entries)
        evaluated = 0
        columns = max(1, min(len(entry_keys), 2048))
        rows = max(1, BOUND_CELLS // columns)
        for top in range(0, len(self.keys), rows):
            part = slice(top, top + rows)
            for left in range(0, len(entry_keys), columns):
                bound = self.cuts[part] @ cuts[left : left + columns].T
                limit = np.maximum(self.score[part], max(self.threshold, 0.0)) - self.slack
                row, column = np.divmod(np.flatnonzero(bound >= limit.astype(np.float32)[:, None]), bound.shape[1])
                row, column = row + top, column + left
                if self.skip_same:
                    other = self.keys[row] != entry_keys[column]
                    row, column = row[other], column[other]
                evaluated += len(row)
                for start in range(0, len(row), EVALUATED_PAIRS):
                    some = slice(start, start + EVALUATED_PAIRS)
                    self._evaluate(row[some], column[some], entry_keys, entries)
        return evaluated

    def _evaluate(self, r: np.ndarray, c: np.ndarray, entry_keys, entries) -> None:
        score = np.einsum("ij,ij->i", self.queries[r], entries[c])
        order = np.lexsort((c, -score, r))
        r, c, score = r[order], c[order], score[order]
        head = np.ones(len(r), bool)
        head[1:] = r[1:] != r[:-1]
        r, c, score = r[head], c[head], score[head]
        better = score > self.score[r]
        tied = np.flatnonzero(score == self.score[r])
        better[tied] = entry_keys[c[tied]] < self.entry[r[tied]]
        r, c, score = r[better], c[better], score[better]
        self.score[r], self.entry[r] = score, entry_keys[c]

    def found(self) -> pd.DataFrame:
        keep = (self.score >= self.threshold) & (self.score > 0)
        return pd.DataFrame({"q": self.keys[keep], "e": self.keys[:0] if self.entry is None else self.entry[keep], "s": self.score[keep]})


def bounded_best(
    query_keys, queries, entry_keys, entries, threshold: float, skip_same: bool, directions: np.ndarray
) -> tuple[pd.DataFrame, int]:
    """Best entry per query (the lowest key on ties) and the number of pairs that had to be evaluated."""
    if not len(query_keys) or not len(entry_keys):
        return pd.DataFrame({"q": query_keys[:0], "e": entry_keys[:0], "s": np.zeros(0)}), 0
    best = BoundedBest(query_keys, queries, threshold, skip_same, directions)
    evaluated = best.see(entry_keys, entries)
    return best.found(), evaluated


def _by_cells(
    q: DataFrame, e: DataFrame, types: str, threshold: float, skip_same: bool, n_pivots: int, cell_rows: int
) -> DataFrame:
    picked = e.orderBy(random_order(["e"], 0)).limit(n_pivots).toPandas()
    shared = e.sparkSession.sparkContext.broadcast(unit_rows(picked["v"]))
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + ROUNDING
    entry_type = f"cell int, {types.split(', ')[1]}, v array<double>"
    query_type = f"cell int, {types.split(', ')[0]}, v array<double>"

    def distances(vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * vectors @ shared.value.T))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = unit_rows(batch["v"])
            live = np.flatnonzero(units.any(axis=1))
            if len(live):
                near = distances(units[live]).argmin(axis=1).astype("int32")
                yield pd.DataFrame({"cell": near, "e": batch["e"].to_numpy()[live], "v": list(units[live])})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = unit_rows(batch["v"])
            live = np.flatnonzero(units.any(axis=1))
            if len(live):
                d = distances(units[live])
                row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius + ROUNDING)
                keys = batch["q"].to_numpy()
                for start in range(0, len(row), COPIED_ROWS):  # a batch may visit hundreds of cells with each vector
                    some = live[row[start : start + COPIED_ROWS]]
                    cells = cell[start : start + COPIED_ROWS].astype("int32")
                    yield pd.DataFrame({"cell": cells, "q": keys[some], "v": list(units[some])})

    placed, visiting = e.mapInPandas(place, entry_type), q.mapInPandas(visit, query_type)
    entry_parts = _parts(placed, cell_rows)
    query_parts = _parts(visiting, cell_rows)
    placed = _split(placed, "e", entry_parts, query_parts, "part_e", "part_q")
    visiting = _split(visiting, "q", query_parts, entry_parts, "part_q", "part_e")

    def compare(qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        return _best(qs["q"].to_numpy(), unit_rows(qs["v"]), es["e"].to_numpy(), unit_rows(es["v"]), threshold, skip_same)

    by = ["cell", "part_e", "part_q"]
    return visiting.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(compare, types)


def _parts(cells: DataFrame, cell_rows: int) -> list[int]:
    """Parts per cell, so that each has about ``cell_rows`` rows; one entry per pivot."""
    sizes = {r["cell"]: math.ceil(r["n"] / cell_rows) for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    return [max(1, sizes.get(i, 1)) for i in range(max(sizes, default=0) + 1)]


def _split(df: DataFrame, key: str, own: list[int], other: list[int], own_name: str, other_name: str) -> DataFrame:
    """Own part from the key; one copy per part of the other side."""

    def per_cell(parts: list[int]):
        listed = F.array(*[F.lit(n) for n in parts])
        return F.coalesce(F.try_element_at(listed, F.col("cell") + 1), F.lit(1))

    part = F.pmod(F.xxhash64(key), per_cell(own)).cast("int")
    copies = F.sequence(F.lit(0), per_cell(other) - 1)
    return df.withColumn(own_name, part).withColumn(other_name, F.explode(copies))
