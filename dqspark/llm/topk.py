"""Exact top-k by inner product over a pivot-distance index.

Vectors v (integers) get one more component so that all have the length of the
longest, M: then |q - v|^2 = |q|^2 + M^2 - 2 <q, v>, and the largest inner
product is the smallest distance.  Each vector is keyed by its nearest pivot and
the distance to it; the keys are range-partitioned and sorted, cut into blocks
of bounded size, and neighbouring blocks form rings (annuli of a pivot).  For a
query and a ring with distances lo..hi from pivot p, the triangle inequality
bounds the distance from below by max(d(q, p) - hi, lo - d(q, p), 0) and so the
score from above.  A first round reads each query's best rings and gives the
score of its k-th best so far; the second reads only the rings whose bound
reaches it.  Query chunks and blocks are packed rows that meet by an equi-join on
the ring, so no task holds more than one pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import small_batches, store

PIVOTS = 64
BLOCK_ROWS = 1024
CHUNK_QUERIES = 512
#: Rings of all pivots together: their bounds are sent to every task.
MAX_RINGS = 4096
FIRST_RINGS = 3
#: Integer components beyond +-2^27 are refused, so that inner products of up to 2^9 of them fit a long.
LARGEST = 1 << 27


def quantized(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) as integers, an error beyond LARGEST; rows with nulls or non-finite values are left out."""
    x = F.col(column)
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    beyond = F.raise_error(F.lit(f"a component of {column} times {scale} lies beyond +-{LARGEST}"))
    held = F.transform(whole, lambda e: F.when(F.abs(e) <= F.lit(LARGEST), e.cast("int")).otherwise(beyond.cast("int")))
    fine = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & (F.abs(e) <= F.lit(1.7976931348623157e308)) & ~F.isnan(e)
    )
    return vectors.where(fine).select(F.col(id_column).cast("long").alias("vec_id"), held.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to one width."""
    out = np.zeros((len(column), width), np.float64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2^53, else integers are used."""
    top = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """Pivots and the length all vectors are brought to."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.pivots, self.norm2 = pivots, norm2

    def distances(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """From each vector to each pivot, in the space with one more component (0 for queries)."""
        p = self.pivots
        last_p = np.sqrt(np.maximum(self.norm2 - (p * p).sum(1), 0))
        own = (vectors * vectors).sum(1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.norm2 - own, 0))
        d2 = (own + last * last)[:, None] + self.norm2 - 2 * (vectors @ p.T + last[:, None] * last_p[None])
        return np.sqrt(np.maximum(d2, 0))


def _bounds(space: Space, rings: pd.DataFrame, queries: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query in each ring, a little above for rounding."""
    d = space.distances(queries, query=True)[:, rings["pivot"].to_numpy()]
    low = np.maximum(np.maximum(d - rings["hi"].to_numpy(), rings["lo"].to_numpy() - d), 0)
    own = (queries * queries).sum(1)[:, None] + space.norm2
    slack = 1e-9 * own + 1e-6
    low = np.maximum(low - 1e-7 * (np.sqrt(own) + 1), 0)
    return (own - low * low) / 2 + slack


def build_index(vectors: DataFrame, width: int, space: Space, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks (ring, pivot, lo, hi, ids, data): every vector is in one."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            d = space.distances(_matrix(p["v"], width))
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pd.DataFrame({"vec_id": p["vec_id"], "v": p["v"], "pivot": near.astype("int32"), "dist": d[np.arange(len(d)), near]})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def flush():
            pivots = [r[0] for r in held]
            rows = []
            for pivot in dict.fromkeys(pivots):
                mine = [r for r in held if r[0] == pivot]
                rows.append(
                    (pivot, mine[0][1], mine[-1][1], np.array([r[2] for r in mine], np.int64).tobytes(), _matrix([r[3] for r in mine], width).astype(np.int32).tobytes())
                )
            held.clear()
            return pd.DataFrame(rows, columns=["pivot", "lo", "hi", "ids", "data"])

        for p in parts:
            for row in zip(p["pivot"], p["dist"], p["vec_id"], p["v"]):
                held.append(row)
                if len(held) == block_rows:
                    yield flush()
        if held:
            yield flush()

    count = vectors.count()
    parts = max(1, min(20_000, count // (4 * block_rows)))
    keys = vectors.mapInPandas(keyed, "vec_id long, v array<int>, pivot int, dist double")
    spread = keys.repartitionByRange(parts, "pivot", "dist", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "dist", "vec_id")
    blocks = store(spread.mapInPandas(packed, "pivot int, lo double, hi double, ids binary, data binary"))
    # rings: the blocks of a pivot between fixed fractions of its range of distances
    per_pivot = max(1, MAX_RINGS // max(1, len(space.pivots)))
    spans = blocks.groupBy("pivot").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    place = F.when(F.col("to") > F.col("from"), (F.col("lo") - F.col("from")) / (F.col("to") - F.col("from")) * per_pivot).otherwise(F.lit(0.0))
    return blocks.join(F.broadcast(spans), "pivot").select(
        (F.col("pivot") * per_pivot + F.least(F.floor(place), F.lit(per_pivot - 1))).cast("int").alias("ring"), "pivot", "lo", "hi", "ids", "data"
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    id_column: str = "vec_id",
    column: str = "embedding",
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query, ties to smaller ids.

    Vectors that are null or hold nulls or non-finite values take no part, on
    either side, nor do rows without an id.  Shorter vectors count as if zeros
    followed.  Rows with the query's id are its own and no candidates; other
    rows that share an id are candidates each.  Queries are taken once per
    distinct (id, vector).  Fewer candidates give fewer rows; empty tables none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = quantized(vectors, id_column, column, scale)
    asked = quantized(queries, id_column, column, scale).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    facts = rows.agg(F.max(norm).alias("norm2"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if facts["width"] is None:
        return spark.createDataFrame([], schema)
    width = max(1, facts["width"], asked.agg(F.max(F.size("v"))).first()[0] or 1)
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    space = Space(np.unique(_matrix(chosen, width), axis=0), float(facts["norm2"]))
    blocks = build_index(rows, width, space, block_rows)
    rings = blocks.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()  # at most MAX_RINGS

    def chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of at most CHUNK_QUERIES queries."""
        for p in parts:
            for i in range(0, len(p), CHUNK_QUERIES):
                yield p.iloc[i : i + CHUNK_QUERIES]

    def send(ring_of: np.ndarray, ids, q, least, used) -> pd.DataFrame:
        out = []
        for j in np.flatnonzero(used.any(0)):
            m = used[:, j]
            out.append((int(ring_of[j]), ids[m].tobytes(), q[m].astype(np.int32).tobytes(), least[m].tobytes()))
        return pd.DataFrame(out, columns=["ring", "q_ids", "q_data", "least"])

    ring_of = rings["ring"].to_numpy()

    def first_rings(q: np.ndarray) -> np.ndarray:
        bound = _bounds(space, rings, q)
        n = min(FIRST_RINGS, bound.shape[1])
        used = np.zeros(bound.shape, bool)
        np.put_along_axis(used, np.argsort(-bound, 1, kind="stable")[:, :n], True, 1)
        return used

    def ask_first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in chunks(parts):
            q = _matrix(p["v"], width)
            yield send(ring_of, p["vec_id"].to_numpy(np.int64), q, np.full(len(p), np.iinfo(np.int64).min), first_rings(q))

    def ask_rest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in chunks(parts):
            q = _matrix(p["v"], width)
            least = p["least"].to_numpy(np.int64)
            used = (_bounds(space, rings, q) >= least[:, None].astype(float)) & ~first_rings(q)
            yield send(ring_of, p["vec_id"].to_numpy(np.int64), q, least, used)

    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for ids, data, q_ids, q_data, least in zip(p["ids"], p["data"], p["q_ids"], p["q_data"], p["least"]):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                b = np.frombuffer(data, np.int32).reshape(-1, width).astype(np.float64)
                q = np.frombuffer(q_data, np.int32).reshape(-1, width).astype(np.float64)
                scores = _products(q, b)
                fit = (scores >= np.frombuffer(least, np.int64)[:, None]) & (ids[None] != q_ids[:, None])
                if scores.shape[1] > k:  # below the k-th highest of the block (ties kept) nothing can win
                    masked = np.where(fit, scores, np.iinfo(np.int64).min)
                    fit &= scores >= np.partition(masked, -k, 1)[:, -k][:, None]
                i, j = np.nonzero(fit)
                order = np.lexsort((ids[j], -scores[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                keep = place < k
                yield pd.DataFrame({"query_id": q_ids[i[keep]], "vec_id": ids[j[keep]], "score": scores[i[keep], j[keep]]})

    found_schema = "query_id long, vec_id long, score long"
    ask_schema = "ring int, q_ids binary, q_data binary, least binary"
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def meet(asking: DataFrame) -> DataFrame:
        return asking.join(blocks, "ring").select("ids", "data", "q_ids", "q_data", "least").mapInPandas(answer, found_schema)

    asked = store(asked.repartition("vec_id"))
    one = store(meet(asked.mapInPandas(ask_first, ask_schema)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    known = one.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    waiting = asked.join(known, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(-(2**63) + 1).cast("long")))
    two = meet(waiting.select("vec_id", "v", "least").mapInPandas(ask_rest, ask_schema))
    every = one.select("query_id", "vec_id", "score").unionByName(two)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
