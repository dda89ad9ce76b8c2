"""Similarity join on word shingles with size-banded tiles and bitmap signatures.

1. A document is the set of its shingle hashes; equal sets are one node.
2. Candidates: shingles are ordered by how often their hash bucket occurs in the
   corpus, rarest first.  Two sets of similarity t share a shingle among the first
   n - ceil(t n) + 1 of each, whatever the order is, so documents that share none
   there are no candidates; frequent shingles stand last and seldom count.
   Neighbours in size that share such a shingle are chained; the components of
   the chains hold every linked pair.
3. A component is cut into bands of size (ratio 1 / t) and tiles of bounded
   length; tiles of one band or of neighbouring bands meet.  First only bitmaps of
   hashed shingles travel, as wide as the set's size asks for: bits of one that
   the other lacks bound the overlap from above.  Pairs that pass leave a
   spanning forest, whose components are the groups of the next step.
4. The sets of these groups are dealt to tiles in the same way and pairs are
   intersected exactly, sorted array against sorted array.
No pair leaves a tile: only how many links a document has and spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import Words, binary_array, grams, mix, small_batches, steps, store
from dqspark.llm.components import components

SHINGLE = 5
#: The limit as a fraction of integers, so that it is exact.
LIMIT = (80, 100)
#: Bits of the bucket table at most (32 MB), and of the pieces it is sent in.
MAX_BITS, PIECE_BITS = 23, 12
TILE = 512
BROADCAST_DOCS = 100_000


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one behind another, and how many each row has.

    A row with fewer than ``n`` words has its whole sequence as one shingle.
    """
    hashes, per_row, first = words.hashes(lower=True), words.per_row, words.row_first[:-1]
    runs = grams(hashes, n)
    row = words.row()
    whole = np.arange(len(runs)) + n <= words.row_first[1:][row[: len(runs)]] if len(runs) else np.zeros(0, bool)
    rows, values = [row[: len(runs)][whole]], [runs[whole]]
    for size in range(1, n):
        short = np.flatnonzero(per_row == size)
        if len(short):
            part = grams(hashes, size)
            rows.append(short)
            values.append(part[first[short]])
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.bincount(rows, minlength=len(per_row))


def _nodes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each row's set; sets without shingles get 0."""
    ends = np.cumsum(sizes)
    some = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    if some.any():
        mixed = values * np.uint64(0x9FB21C651E98DF25)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        total = np.add.reduceat(mixed, (ends - sizes)[some])
        out[some] = np.maximum(mix(total ^ mix(sizes[some].astype(np.uint64))), np.uint64(1))
    return out.view(np.int64)


def signatures(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A bitmap of each row's shingle hashes, the power of two of bits that is at least their number (64 at least)."""
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(width)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    place = (values & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    bits[np.repeat(ends - width, sizes) + place] = True
    return binary_array(np.packbits(bits, bitorder="little"), ends // 8)


def _prefix(sizes: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    """How many of the first shingles a set must offer."""
    need = -(-sizes * limit[0] // limit[1])
    return np.where(sizes > 0, sizes - need + 1, 0)


def _batches(function, schema: pa.Schema):
    """A mapInArrow function from one that turns (batch, words) into arrays."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(parts):
            yield pa.RecordBatch.from_arrays(function(batch, Words(batch.column("text"))), schema=schema)

    return run


class Frequencies:
    """Occurrences of shingles by bucket of their hash: a table of bounded size."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(64 - bits), table

    def of(self, values: np.ndarray) -> np.ndarray:
        return self.table[(values >> self.shift).astype(np.int64)]


def bucket_counts(texts: DataFrame, n: int, shingles: int) -> Frequencies:
    """Counts over all documents, in about a bucket for every 32 of the ``shingles``, 2^23 at most.

    Every task sends its table in pieces, a byte a bucket and what is above 255
    apart; a piece is summed row by row, whatever the number of tasks.
    """
    bits = min(MAX_BITS, max(PIECE_BITS, (shingles // 32).bit_length()))
    pieces, width = 1 << (bits - PIECE_BITS), 1 << PIECE_BITS

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces * width, np.uint32)
        for batch in steps(parts):
            values, _ = shingle_sets(Words(batch.column("text")), n)
            places, times = np.unique((values >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            total[places] += times.astype(np.uint32)
        table = total.reshape(pieces, width)
        low = np.minimum(table, 255).astype(np.uint8)
        high = table - low
        for layer in (low, high):
            some = np.flatnonzero(layer.any(1))
            for i in range(0, len(some), 512):
                part = some[i : i + 512]
                data = pa.array([layer[j].tobytes() for j in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), data], names=["piece", "data"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(width, np.int64)

        def row() -> pa.RecordBatch:
            data = pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), data], names=["piece", "data"])

        for batch in parts:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data")):
                if piece != current:
                    if current is not None:
                        yield row()
                    current, total = piece, np.zeros(width, np.int64)
                data = data.as_buffer()
                total += np.frombuffer(data, np.uint8 if data.size == width else np.uint32)
        if current is not None:
            yield row()

    sent = texts.mapInArrow(count, "piece int, data binary").repartition("piece").sortWithinPartitions("piece")
    table = np.zeros((pieces, width), np.int32)
    for r in sent.mapInArrow(add, "piece int, data binary").collect():  # 32 MB at most
        table[r["piece"]] = np.frombuffer(r["data"], np.int32)
    return Frequencies(bits, table.reshape(-1))


def _find_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of ``left`` the j of ``right`` with 100 |A n B| >= 80 |A u B|; i itself is left out."""
    size = np.array([len(s) for s in sets])
    band = max(64, 1 << int(size.max()).bit_length())
    bits = np.zeros((len(sets), band // 64), np.uint64)
    for i, s in enumerate(sets):
        places = s % np.uint64(band)
        np.bitwise_or.at(bits[i], (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    right = right[np.argsort(size[right], kind="stable")]
    sizes = size[right]
    low, high = limit
    for i in left:
        n = size[i]
        # only sizes within the ratio; then the bound on the overlap by bits that one has and the other lacks
        a = np.searchsorted(sizes, -(-n * low // high), "left")
        b = np.searchsorted(sizes, n * high // low, "right")
        near = right[a:b]
        near = near[near != i]
        if not len(near):
            continue
        m = size[near]
        need = -(-(n + m) * low // (low + high))
        mine = np.bitwise_count(bits[i] & ~bits[near]).sum(1)
        theirs = np.bitwise_count(bits[near] & ~bits[i]).sum(1)
        near = near[np.minimum(n - mine.astype(np.int64), m - theirs.astype(np.int64)) >= need]
        if not len(near):
            continue
        together = np.concatenate([sets[j] for j in near])
        place = np.minimum(np.searchsorted(sets[i], together), n - 1)
        hit = sets[i][place] == together
        m = size[near]
        common = np.add.reduceat(hit, np.cumsum(m) - m)
        yield i, near[high * common >= low * (n + m - common)]


class _Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.of[max(i, j)] = min(i, j)


def _tile(rows: list[tuple], limit: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(node, root, links) of one pair of tiles; rows are (side, node, copies, set).

    Side 0 and 1 stand across; side 2 is a tile on its own, compared with itself.
    A node that was read from several rows counts once.
    """
    rows = list({(r[0], r[1]): r for r in rows}.values())
    side = np.array([r[0] for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    copies = np.array([r[2] for r in rows], np.int64)
    across = bool((side == 0).any() or (side == 1).any())
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    links = np.zeros(len(rows), np.int64)
    union = _Union(len(rows))
    for i, found in _find_pairs(sets, left, right, limit):
        if len(found):
            links[i] += copies[found].sum()
            if across:
                links[found] += copies[i]
            for j in found:
                union.join(int(i), int(j))
    nodes = [r[1] for r in rows]
    return [(nodes[i], nodes[union.root(i)], int(links[i])) for i in range(len(rows))]


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer bits: places are counted modulo the width."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), 0)


def _bound_tile(rows: list[tuple], limit: tuple[int, int]) -> list[tuple[int, int]]:
    """(node, root) of the pairs whose bitmaps allow a link; rows are (side, node, n, bitmap)."""
    low, high = limit
    side = np.array([r[0] for r in rows])
    size = np.array([r[2] for r in rows], np.int64)
    bits = [np.frombuffer(r[3], np.uint64) for r in rows]
    words = np.array([len(b) for b in bits])
    at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(words).tolist():
        wide = np.flatnonzero(words >= w)
        place = np.full(len(rows), -1)
        place[wide] = np.arange(len(wide))
        at[w] = place, np.stack([_fold(bits[j], w) for j in wide])
    right = np.flatnonzero(side != 0)
    right = right[np.argsort(size[right], kind="stable")]
    sizes = size[right]
    union = _Union(len(rows))
    for i in np.flatnonzero(side != 1).tolist():
        n = int(size[i])
        a = np.searchsorted(sizes, -(-n * low // high), "left")
        b = np.searchsorted(sizes, n * high // low, "right")
        near = right[a:b]
        near = near[near != i]
        common = np.minimum(words[near], words[i])
        for w in np.unique(common).tolist():
            some = near[common == w]
            place, table = at[w]
            own, others = table[place[i]], table[place[some]]
            m = size[some]
            need = -(-(n + m) * low // (low + high))
            mine = np.bitwise_count(own & ~others).sum(1).astype(np.int64)
            theirs = np.bitwise_count(others & ~own).sum(1).astype(np.int64)
            for j in some[np.minimum(n - mine, m - theirs) >= need].tolist():
                union.join(i, j)
    nodes = [r[1] for r in rows]
    return [(nodes[i], nodes[r]) for i in range(len(rows)) if (r := union.root(i)) != i]


def _in_tiles(work, limit: tuple[int, int], inputs: list[str], outputs: list[str]):
    """Rows sorted by tile pair come in; a pair is worked on when its last row was seen."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None
        done: list[tuple] = []

        def batch(rows):
            columns = list(zip(*rows)) if rows else [()] * len(outputs)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=outputs)

        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("tile", *inputs)]
            for tile, *row in zip(*columns):
                if tile != name:
                    if len(held) > 1:
                        done += work(held, limit)
                    held, name = [], tile
                held.append(tuple(row))
            if len(done) > 10_000:
                yield batch(done)
                done = []
        if len(held) > 1:
            done += work(held, limit)
        yield batch(done)

    return run


def _deal(members: DataFrame, limit: tuple[int, int], tile: int) -> DataFrame:
    """(node, tiles): the pairs of tiles in which each of ``members`` (node, root, n) stands, with its side.

    A group that fits one tile is one; a larger one is cut by bands of size and
    each band by a hash, so that no step needs a group's rows in one place.
    """
    low, high = limit
    lit = F.lit
    ratio = log(high / low) * (1 + 1e-9)  # a little wider: rounding must not set partners two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / lit(ratio)).cast("int")
    sizes = members.groupBy("root").agg(F.count(lit(1)).alias("in_group"))
    placed = members.join(sizes, "root").withColumn("band", F.when(F.col("in_group") > tile, band).otherwise(lit(0)))
    crowd = store(placed.groupBy("root", "band").agg(F.ceil(F.count(lit(1)) / lit(tile)).cast("int").alias("tiles")))
    above = crowd.select("root", (F.col("band") - 1).alias("band"), F.col("tiles").alias("tiles_above"))
    below = crowd.select("root", (F.col("band") + 1).alias("band"), F.col("tiles").alias("tiles_below"))
    placed = placed.join(crowd, ["root", "band"]).join(above, ["root", "band"], "left").join(below, ["root", "band"], "left")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def entry(side, *parts):
        return F.struct(F.concat_ws(":", "root", *parts).alias("tile"), side.alias("side"))

    def each(count: str, make):
        n = F.coalesce(F.col(count), lit(0))
        none = F.array().cast("array<struct<tile:string,side:int>>")
        return F.when(n > 0, F.transform(F.sequence(lit(0), n - 1), make)).otherwise(none)

    own = F.array(entry(lit(2), F.col("band"), F.col("salt")))
    others = F.filter(F.sequence(lit(0), F.col("tiles") - 1), lambda s: s != F.col("salt"))
    same = F.transform(
        others,
        lambda s: entry(F.when(F.col("salt") < s, 0).otherwise(1), F.col("band"), F.least("salt", s), F.greatest("salt", s), lit("same")),
    )
    up = each("tiles_above", lambda s: entry(lit(0), F.col("band"), F.col("salt"), s, lit("up")))
    down = each("tiles_below", lambda s: entry(lit(1), F.col("band") - 1, s, F.col("salt"), lit("up")))
    return store(placed.select("node", F.concat(own, same, up, down).alias("tiles")))


def _meet(payload: DataFrame, dealt: DataFrame, work, limit: tuple[int, int], inputs: list[str], outputs: list[str]) -> DataFrame:
    """Work on every pair of tiles; ``payload`` has a node's columns."""
    rows = payload.join(dealt, "node").select(*payload.columns, F.explode("tiles").alias("t"))
    rows = rows.select("t.tile", "t.side", *payload.columns).repartition("tile").sortWithinPartitions("tile")
    run = _in_tiles(work, limit, ["side", *inputs], outputs)
    return store(rows.mapInArrow(run, ", ".join(f"{c} long" for c in outputs)))


def similar_documents(docs: DataFrame, n: int = SHINGLE, limit: tuple[int, int] = LIMIT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every document row.

    component_id is the smallest doc_id that links lead to; n_links counts the
    rows linked directly, equal copies included.  Null, empty and blank texts
    have no shingles, link with nothing and are their own component, as does a
    row without doc_id (its component is null unless its text links it to one
    that has an id).  Rows that repeat are copies of each other.  An empty table
    gives an empty one.  Extra columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low, high = limit
    texts = docs.select("text")

    def name(batch: pa.RecordBatch, words: Words) -> list[pa.Array]:
        values, sizes = shingle_sets(words, n)
        return [batch.column("doc_id"), pa.array(_nodes(values, sizes)), pa.array(sizes.astype(np.int64)), signatures(values, sizes)]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    one = docs.select("doc_id", "text").mapInArrow(
        _named(name, ["doc_id", "node", "n_shingles", "bits"]), f"doc_id {id_type}, node long, n_shingles long, bits binary"
    )
    one = store(one)
    nodes = one.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n")
    )
    nodes = store(nodes)
    shingles = one.agg(F.sum("n_shingles")).first()[0] or 0
    counts = spark.sparkContext.broadcast(bucket_counts(texts, n, shingles))

    def offer(batch: pa.RecordBatch, words: Words) -> list[pa.Array]:
        values, sizes = shingle_sets(words, n)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((values, counts.value.of(values), row))
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        nodes = _nodes(values, sizes)
        once = np.zeros(len(nodes), bool)
        once[np.unique(nodes, return_index=True)[1]] = True
        chosen = (place < np.repeat(_prefix(sizes, limit), sizes)) & once[row]
        return [
            pa.array(values[order][chosen].view(np.int64)),
            pa.array(nodes[row[chosen]]),
            pa.array(sizes[row[chosen]].astype(np.int32)),
        ]

    keys = texts.mapInArrow(_named(offer, ["key", "node", "n"]), "key long, node long, n int")
    chains = keys.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_chain(limit), "a long, b long")
    groups = components(chains)
    facts = nodes.select("node", "n", "copies")
    bitmaps = one.join(groups.select("node"), "node").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    dealt = _deal(groups.join(facts, "node").select("node", "root", "n"), limit, tile)
    near = components(_meet(bitmaps, dealt, _bound_tile, limit, ["node", "n", "bits"], ["a", "b"]))

    # the sets of the members alone are made again, from one row of each
    dealt = _deal(near.join(facts, "node").select("node", "root", "n"), limit, tile)
    chosen = dealt.select("node").join(facts.select("node", "copies"), "node")

    def sets(batch: pa.RecordBatch, words: Words) -> list[pa.Array]:
        values, sizes = shingle_sets(words, n)
        return [pa.array(_nodes(values, sizes)), binary_array(values.view(np.uint8), np.cumsum(sizes) * 8)]

    first = store(dealt.select("node").join(nodes.select("node", "first_id"), "node"))
    held = first.select(F.col("first_id").alias("doc_id"))
    held = F.broadcast(held) if first.count() <= BROADCAST_DOCS else held.hint("shuffle_hash")
    source = docs.select("doc_id", "text")
    if first.where("first_id IS NULL").isEmpty():  # texts of rows without an id are not found by it
        source = source.join(held, "doc_id", "left_semi")
    payload = source.select("text").mapInArrow(_named(sets, ["node", "hashes"]), "node long, hashes binary")
    payload = payload.join(chosen, "node").select("node", "copies", "hashes")
    compared = _meet(payload, dealt, _tile, limit, ["node", "copies", "hashes"], ["node", "root", "links"])
    joined = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.join(joined, "node", "left").join(links, "node", "left")
    facts = facts.withColumn("class", F.coalesce("root", "node"))
    smallest = facts.groupBy("class").agg(F.min("first_id").alias("component_id"))
    facts = facts.join(smallest, "class").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some, none = one.where("n_shingles > 0"), one.where("n_shingles = 0")
    return (
        some.join(facts, "node").select("doc_id", "n_shingles", "component_id", "n_links")
        .unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    )


def _named(function, names: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(parts):
            yield pa.RecordBatch.from_arrays(function(batch, Words(batch.column("text"))), names=names)

    return run


def _chain(limit: tuple[int, int]):
    """Rows in order of (key, n, node): neighbours of one key whose sizes fit are an edge.

    Sizes rise, so if two sets of a key fit, all between them do: chains lose no pair.
    """
    low, high = limit

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (0, 0, 0)
        begun = False
        for batch in parts:
            if not batch.num_rows:
                continue
            key, node, n = (np.concatenate(([v], batch.column(c).to_numpy())) for v, c in zip(last, ("key", "node", "n")))
            edge = (key[1:] == key[:-1]) & (node[1:] != node[:-1]) & (n[:-1] * high >= n[1:].astype(np.int64) * low)
            if not begun:
                edge[0] = False
            begun = True
            last = (key[-1], node[-1], n[-1])
            a, b = node[1:][edge], node[:-1][edge]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run
