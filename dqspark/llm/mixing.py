"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share the wanted number of words by weight, none above ``max_repeats``
times its source.  A source's target becomes a number of equal blocks, and these
are dealt to the source's shards by highest quotients (words of a shard over 1,
3, 5, ...).  What is left below a block, or above what a shard may give, goes to
shards with room, so that a source gives its target to the word.  Within a shard
the documents lie on a line in seeded order; the line is cut into blocks, which
are taken in the order of a seeded permutation, the last one in part.  Shards
bound the size of every sort, a hot source has many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import count_words

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 64
SHARD_WORDS = 2_000_000
SEED = "mix-1"
#: Pairs of a prime step and the permutation it gives: block b is at place (b * step + turn) mod n.
STEP = 1_000_003


def digits(text: Column, start: int) -> Column:
    """Seven hex digits of a digest as a number."""
    return F.conv(F.substring(text, start, 7), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    A source is full where its share by weight reaches its limit.  With sources
    in the order of limit over weight the full ones come first, so the level is
    found by running sums: no loop.  The table has a row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("weight", F.get(table, ((F.row_number().over(named) - 1) % len(weights)).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("rest", F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("rest") / F.sum("weight").over(behind))
        .withColumn("full", F.col("rate") >= F.col("level"))
        .withColumn("open_rate", F.max(F.when(~F.col("full"), F.col("rate"))).over(everything))  # it falls along the order
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("open_rate")))
        .select("source", "source_size", "target")
    )


def _words_of_shards(quotas: DataFrame, block_words: int, max_repeats: int) -> DataFrame:
    """``give``, the words of each shard: its blocks as far as it may repeat, and what is left of the source's goal.

    The rest fills shards in their order, each up to its limit; as a goal is never
    above the source's limit, it always fits.
    """
    same = Window.partitionBy("source")
    most = F.col("shard_words") * max_repeats
    before = same.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        quotas.withColumn("sure_words", F.least(F.col("quota") * block_words, most))
        .withColumn("room", most - F.col("sure_words"))
        .withColumn("rest", F.col("goal") - F.sum("sure_words").over(same) - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("give", F.col("sure_words") + F.least(F.col("room"), F.greatest(F.col("rest"), F.lit(0))))
    )


def apportion(shards: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``shards`` (source, shard, shard_words, wanted blocks) with the integer ``quota`` of each.

    The shard gets a block for each of the source's ``wanted`` = N highest quotients
    words / (2 k + 1).  With n shards and exact share e the number of a shard lies
    between e (N - n / 2) / N, rounded down, and e (N + n / 2) / N + 1: only the
    quotients between, 3 n in all, are ranked.  Ties go to the lower shard.
    """
    same = Window.partitionBy("source")
    per_word = F.when(F.col("wanted") > 0, F.col("shard_words") / F.sum("shard_words").over(same)).otherwise(F.lit(0.0))
    half = F.count(F.lit(1)).over(same) / 2
    known = (
        shards.withColumn("sure", F.floor(per_word * F.greatest(F.lit(0.0), F.col("wanted") - half)).cast("long"))
        .withColumn("most", F.floor(per_word * (F.col("wanted") + half)).cast("long") + 1)
        .withColumn("left", F.col("wanted") - F.sum("sure").over(same))
        .where("shard_words > 0")
    )
    tried = known.select("source", "shard", "shard_words", "left", F.explode(F.sequence("sure", "most")).alias("k"))
    best = Window.partitionBy("source").orderBy((F.col("shard_words") / (2 * F.col("k") + 1)).desc(), "shard")
    more = (
        tried.withColumn("place", F.row_number().over(best)).where("place <= left")
        .groupBy("source", "shard").agg(F.count(F.lit(1)).alias("more"))
    )
    joined = known.alias("a").join(
        more.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard")), "left"
    )
    return joined.select(
        "a.source", "a.shard", "shard_words", *keep, (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota")
    )


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, taken.

    Null texts have size 0 and take nothing; a null source is a source of its
    own, last in order.  Rows that repeat are documents of their own.  An empty
    table gives an empty one.  Other columns are not looked at.
    """
    sized = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, share, weights, max_repeats)
    goals = goals.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # a row per source; which side is small is left to Spark
    rows = sized.withColumn("digest", digest).alias("d").join(
        goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")), "left"
    )
    rows = rows.select(
        "doc_id", "d.source", "size", "source_size", "target", "digest", (digits(F.col("digest"), 1) % F.col("shards")).alias("shard"),
    )
    line = Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size")
    laid = rows.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_words"), F.first("target").alias("target"))
    goal = F.round(F.col("target")).cast("long")
    quotas = apportion(sums.withColumn("wanted", F.floor(goal / block_words).cast("long")).withColumn("goal", goal), ("goal",))
    quotas = _words_of_shards(quotas, block_words, max_repeats)
    blocks = F.ceil(F.col("shard_words") / block_words).cast("long")
    quotas = (
        quotas.withColumn("blocks", blocks)
        .withColumn("times", F.floor(F.col("give") / F.col("shard_words")).cast("long"))
        .withColumn("extra", F.col("give") - F.col("times") * F.col("shard_words"))
        .withColumn("turn", digits(F.md5(F.concat_ws("|", F.lit(seed), F.col("source"), F.col("shard").cast("string"))), 1))
    )
    # the last block of the line may be short; behind its place in the order, places begin that much earlier
    short = F.col("blocks") * block_words - F.col("shard_words")
    short_place = ((F.col("blocks") - 1) * F.lit(STEP) + F.col("turn")) % F.col("blocks")
    passed = F.col("extra") >= (short_place + 1) * block_words - short
    reach = F.col("extra") + F.when(passed, short).otherwise(0)
    quotas = quotas.withColumn("whole", F.floor(reach / block_words).cast("long")).withColumn("part", reach % block_words)
    joined = laid.alias("l").join(
        quotas.alias("q"), F.col("l.source").eqNullSafe(F.col("q.source")) & (F.col("l.shard") == F.col("q.shard")), "left"
    )
    low, high = F.col("upto") - F.col("size"), F.col("upto")
    lit = F.lit(block_words)

    def words_in(b: Column) -> Column:
        place = (b * F.lit(STEP) + F.col("turn")) % F.col("blocks")
        until = F.when(place < F.col("whole"), lit).when(place == F.col("whole"), F.col("part")).otherwise(F.lit(0))
        inside = F.least(high, b * lit + until) - F.greatest(low, b * lit)
        return F.greatest(inside, F.lit(0)).cast("long")

    last = F.floor((high - 1) / lit).cast("long")
    some = F.aggregate(
        F.sequence(F.floor(low / lit).cast("long"), last), F.lit(0).cast("long"), lambda total, b: total + words_in(b)
    )
    taken = F.when(F.col("size") > 0, F.col("times") * F.col("size") + some).otherwise(F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "l.source", "size", "source_size", F.col("target").cast("double"), taken.alias("taken")
    )
