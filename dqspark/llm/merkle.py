"""Merkle manifest of a table: a tree per source, one tree over the sources, a proof for every row.

Leaves are numbered along (source, id) by a range partition and counts per
partition, so no source is sorted in one task.  A level of the trees is a slot
pivot: one group-by on the parent's position spreads its children into as many
columns as the fanout by conditional aggregates; the concatenated columns hash
to the parent.  Proofs go down the same pivots: a child's siblings are all slot
columns but its own, left ones and right ones, in front of its parent's proof.
Digests travel as 32 bytes and are hashed as hexadecimal text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import store

FANOUT = 3
#: Levels up to which one plan walks down before its rows are stored.
LEVELS_A_PLAN = 6
_PROOF = "array<struct<l: binary, r: binary>>"


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(*texts: Column) -> Column:
    """SHA-256 (binary) of concatenated texts."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and value, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return hashed(*(field(v) for v in values))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, its position from 0 along non-null columns; rows that equal each other in any order."""
    spread = df.withColumn("_salt", F.monotonically_increasing_id() % 4096)  # cuts long runs of equal rows
    held = store(
        spread.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    # one row per partition: their number is the number of shuffle partitions
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", "_n").collect()
    before, offsets = 0, {}
    for r in sorted(counts):
        offsets[r["_part"]] = before
        before += r["_n"]
    pairs = [(p, n) for p, n in offsets.items()] or [(0, 0)]
    small = df.sparkSession.createDataFrame(pairs, "_part long, _before long")
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.join(F.broadcast(small), part == F.col("_part"))
        .withColumn("place", F.col("_before") + inner).drop("_part", "_before", "_at")
    )


def _slots() -> list[Column]:
    slot = F.col("pos") % FANOUT
    return [F.max(F.when(slot == i, F.col("digest"))).alias(f"s{i}") for i in range(FANOUT)]


def _shown(name: str) -> Column:
    """A slot as text, empty where the run is shorter."""
    return F.coalesce(hex_text(F.col(name)), F.lit(""))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pivots of all levels, from the leaves up, and the top of each tree.

    ``nodes`` has ``tree``, ``pos`` (from 0), ``n`` (nodes of the tree) and
    ``digest``.  A tree with one node is its own top.  Tops have ``tree``, ``level``
    and ``digest``.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    pivots, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "digest"))
        if most <= 1:
            return pivots, reduce(DataFrame.unionByName, tops)
        up = F.expr(f"pos div {FANOUT}").alias("up")
        pivot = store(nodes.where("n > 1").groupBy("tree", up, "n").agg(*_slots()).withColumnRenamed("up", "pos"))
        pivots.append(pivot)
        digest = hashed(*(_shown(f"s{i}") for i in range(FANOUT)))
        nodes = pivot.select("tree", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"))
        most, level = -(-most // FANOUT), level + 1


def _siblings(slot: Column) -> Column:
    """The step of a proof for the child in a slot: the columns left of it and right of it."""
    columns = [F.coalesce(F.col(f"s{i}"), F.lit(b"")) for i in range(FANOUT)]
    step = None
    for own in range(FANOUT):
        left = F.concat(F.lit(b""), *columns[:own])
        right = F.concat(F.lit(b""), *columns[own + 1 :])
        this = F.struct(left.alias("l"), right.alias("r"))
        step = F.when(slot == own, this) if step is None else step.when(slot == own, this)
    return step


def descend(pivots: list[DataFrame], tops: DataFrame, level: int = 0) -> DataFrame:
    """Proof steps (``tree``, ``pos``, ``proof``) of every node of a level.

    ``tops`` has ``tree``, ``level`` and ``proof``, the steps above the tree.
    """

    def at(k: int) -> DataFrame:
        return tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("pos"), "proof")

    below = at(len(pivots))
    for k in range(len(pivots) - 1, level - 1, -1):
        pivot = pivots[k]
        present = F.filter(
            F.array(*(F.when(F.col(f"s{i}").isNotNull(), F.lit(i)) for i in range(FANOUT))), lambda i: i.isNotNull()
        )
        children = pivot.join(below, ["tree", "pos"]).withColumn("slot", F.explode(present))
        rows = children.select(
            "tree", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"),
            F.concat(F.array(_siblings(F.col("slot"))), "proof").alias("proof"),
        )
        below = rows.unionByName(at(k))
        if (len(pivots) - k) % LEVELS_A_PLAN == 0:
            below = store(below)
    return below


def folded(leaf: Column, proof: Column) -> Column:
    """The root a leaf and the steps of its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: hashed(hex_text(s["l"]), hex_text(acc), hex_text(s["r"])))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: hex_text(F.concat(s["l"], s["r"]))), "").cast("binary"), 256)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Every row with its leaf, subroot, root, proof and the root that its tampered form folds to.

    Rows whose id has an even CRC-32 are tampered with: their text loses its line
    breaks; the others, those without an id among them, fold their own leaf.
    Nulls of any field count as ``-``; a null source is a source of its own, before
    the others; rows without an id come first in theirs; equal ids are ordered by
    their leaf, so repeated rows stand side by side and have their own proofs.
    Other columns are not read.  An empty table gives no rows.

    Returns id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``,
    ``verified`` and ``proof`` (steps of left and right siblings, binary).
    """
    marked = docs.withColumn("_changed", F.coalesce(F.crc32(F.col(id_column).cast("string")) % 2 == 0, F.lit(False)))
    breaks = F.regexp_replace(F.col(text), "\n", "")
    altered = leaf_digest(*(breaks if f == text else F.col(f) for f in fields))
    leaves = marked.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
        leaf_digest(*(F.col(f) for f in fields)).alias("digest"),
        F.when(F.col("_changed") & F.contains(F.col(text), F.lit("\n")), altered).alias("altered"),
    )
    in_order = store(numbered(leaves.withColumn("known", F.col("id").isNotNull()).withColumn(
        "rank_id", F.coalesce("id", F.lit(0).cast(leaves.schema["id"].dataType))
    ), "key", "known", "rank_id", "digest").drop("known", "rank_id"))

    sources = numbered(in_order.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")), "key")
    sources = store(sources.withColumnRenamed("place", "tree"))
    placed = in_order.join(sources, "key").select(
        "id", "tree", (F.col("place") - F.col("first")).alias("pos"), "n", "digest", "altered"
    )
    pivots, tops = climb(placed)
    subroots = store(tops)
    how_many = sources.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(how_many).cast("long").alias("n"), "digest")
    top_pivots, top = climb(over)
    root = top.select("digest").first()
    nothing = F.array().cast(_PROOF)
    proofs = descend(top_pivots, top.select("tree", "level", nothing.alias("proof")))
    heads = subroots.withColumnRenamed("digest", "subroot").join(
        proofs.select(F.col("pos").alias("tree"), "proof"), "tree"
    )
    heads = store(heads)

    # one-leaf trees have their proof from above; the others hang on the lowest pivot
    lonely = placed.where("n = 1").join(heads.select("tree", "proof"), "tree")
    lonely = lonely.select("id", "tree", "digest", "altered", "proof")
    if pivots:
        tall = heads.where("level > 0").select("tree", "level", "proof")
        parents = descend(pivots, tall, level=1).withColumnRenamed("pos", "up")
        lowest = pivots[0].withColumnRenamed("pos", "up").drop("n")
        hung = placed.where("n > 1").withColumn("up", F.expr(f"pos div {FANOUT}"))
        hung = hung.join(lowest.join(parents, ["tree", "up"]), ["tree", "up"]).select(
            "id", "tree", "digest", "altered",
            F.concat(F.array(_siblings(F.col("pos") % FANOUT)), "proof").alias("proof"),
        )
        lonely = hung.unionByName(lonely)
    root_digest = F.lit(bytes(root[0]) if root else b"")
    return (
        lonely.join(heads.select("tree", "subroot"), "tree")
        .withColumn("fold", folded(F.coalesce("altered", "digest"), F.col("proof")))
        .select(
            F.col("id").alias(id_column), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
            hex_text(root_digest).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"),
            hex_text(F.col("fold")).alias("folded_root"), (F.col("fold") == root_digest).alias("verified"), "proof",
        )
    )
