"""Connected components by repeated contraction.

Every node takes the smallest of itself and its neighbours, then that one's
choice (two hops a round); edges are rewritten to the chosen nodes and the
repeated ones and loops go.  Labels only fall within a component, so the
smallest node of each is left.  Nodes should be spread like hashes: then a round
leaves a fraction of the nodes.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Loops and repeated edges are allowed; nulls are not nodes.  No edges, no rows.
    """
    left = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    roots = None
    while not left.isEmpty():
        near = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("next"))
        hop = store(hop)
        far = hop.select(F.col("node").alias("next"), F.col("next").alias("root"))
        jumped = store(hop.join(far, "next").select("node", "root"))
        roots = jumped if roots is None else store(_carry(roots, jumped))
        a = jumped.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = jumped.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = store(
            left.join(a, "a").join(b, "b").where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        )
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    return roots


def _carry(roots: DataFrame, jumped: DataFrame) -> DataFrame:
    """Roots after one more round; a root that is no longer in an edge stays."""
    moved = jumped.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
