"""Stratified sample of suspicious rows.

Every row names the strata it belongs to; each task keeps the first rows of
every stratum in a buffer of bounded size while it reads, so marked rows are
neither sorted nor shuffled, and a stratum that holds most of the table costs no
more than a small one.  Buffers are merged in parts of a stratum, then whole.
All later steps work on these few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.operators import rules, stats
from dqspark.operators.columns import col, columns_of, known, missing_count

RANDOM, ISSUE, CONTRADICTION = "random", "issue", "contradiction"
GROUPS = (RANDOM, ISSUE, CONTRADICTION)
#: Types of keys whose order is the same in the buffers as in Spark.
BUFFERED = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType,
)
#: Parts in which the buffers of a stratum are merged first.
MERGE_PARTS = 32


@dataclass(frozen=True)
class Stratum:
    """Rows under a condition, in key order or (``seed``) in repeatable random order."""

    group: str
    reason: str
    condition: Column
    cap: int
    seed: int | None = None


def random_order(keys: Sequence[str], seed: int) -> Column:
    """A repeatable shuffle of rows: the digest of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def quartile_pairs(
    df: DataFrame, approx: bool = False, columns: Sequence[str] | None = None
) -> dict[str, list[float | None]]:
    """Lower and upper quartile of numeric columns."""
    names = columns_of(df, "numeric") if columns is None else columns
    return stats.quantiles(df, {c: [0.25, 0.75] for c in names}, approx)


def issue_strata(df: DataFrame, count: int, seed: int, quartiles: dict[str, list[float | None]]) -> list[Stratum]:
    """Rows with many missing values, outliers per numeric column, random rest."""
    strata = [
        Stratum(ISSUE, "high_missing", missing_count(df) > len(df.columns) * 0.2, count // 2)
    ]
    for c, (q1, q3) in quartiles.items():
        if q1 is not None and q3 > q1:
            reach = 1.5 * (q3 - q1)
            beyond = (known(df, c) < q1 - reach) | (known(df, c) > q3 + reach)
            strata.append(Stratum(ISSUE, f"outlier:{c}", beyond, count // 4))
    strata.append(Stratum(ISSUE, "top_up", F.lit(True), count, seed + 1))
    return strata


def contradiction_strata(df: DataFrame, count: int, quartiles: dict[str, list[float | None]]) -> list[Stratum]:
    """Exclusive options, conflicting terms, negative and extreme numbers, then
    unusual text (U6)."""
    strata = []
    for parts, chosen in V.EXCLUSIVE_OPTIONS:
        matching = rules.named_like(df.columns, parts)
        if len(matching) >= 2:
            rule = rules.both_chosen(matching[0], matching[1], chosen)
            strata.append(Stratum(CONTRADICTION, f"both:{matching[0]}+{matching[1]}", F.expr(rule.detection_code), count))
    for parts, terms in V.CONFLICTING_TERMS:
        for c in rules.named_like(df.columns, parts):
            rule = rules.conflicting_terms(c, terms)
            strata.append(Stratum(CONTRADICTION, f"terms:{c}", F.expr(rule.detection_code), count))
    for c in columns_of(df, "numeric"):
        if rules.named_like([c], V.NON_NEGATIVE_NAMES):
            strata.append(Stratum(CONTRADICTION, f"negative:{c}", known(df, c) < 0, min(10, count // 4)))
        if rules.named_like([c], V.EXTREME_NAMES) and quartiles[c][1] is not None:
            beyond = known(df, c) > 10 * quartiles[c][1]
            strata.append(Stratum(CONTRADICTION, f"extreme:{c}", beyond, min(5, count // 6)))
    for c in columns_of(df, "text"):
        rule = rules.unusual_text(c)
        strata.append(Stratum(CONTRADICTION, f"unusual:{c}", F.expr(rule.detection_code), count))
    return strata


def candidates(df: DataFrame, keys: Sequence[str], strata: Sequence[Stratum]) -> DataFrame:
    """The first ``cap`` rows of each stratum: keys, stratum number and place.

    A random stratum reads the key columns only and keeps ``cap`` rows per task
    while it reads.  The others share one scan.
    """
    names = [col(k) for k in keys]
    parts = [
        _first_shuffled(df, keys, i, s) for i, s in enumerate(strata) if s.seed is not None
    ]
    plain = [(i, s) for i, s in enumerate(strata) if s.seed is None]
    if plain:
        buffered = all(isinstance(t, BUFFERED) or t == T.StringType() for t in (df.schema[k].dataType for k in keys))
        rows = _buffered(df, keys, plain) if buffered else _marked(df, keys, plain)
        order = Window.partitionBy("stratum").orderBy(*names)
        caps = F.element_at(F.array(*[F.lit(s.cap) for s in strata]), F.col("stratum") + 1)
        placed = rows.withColumn("at", F.row_number().over(order))
        # the literal limit is what Spark can apply before the shuffle
        parts.append(placed.where(F.col("at") <= max(s.cap for _, s in plain)).where(F.col("at") <= caps))
    return reduce(DataFrame.unionByName, parts)


def _strata_of(plain: Sequence[tuple[int, Stratum]]) -> Column:
    return F.array_compact(F.array(*[F.when(s.condition, F.lit(i)) for i, s in plain]))


def _marked(df: DataFrame, keys: Sequence[str], plain: Sequence[tuple[int, Stratum]]) -> DataFrame:
    """Keys and stratum of every marked row."""
    # explode_outer, as explode makes Spark compute all conditions once more in a filter below
    rows = df.select(*[col(k) for k in keys], F.explode_outer(_strata_of(plain)).alias("stratum"))
    return rows.where(F.col("stratum").isNotNull())


def _buffered(df: DataFrame, keys: Sequence[str], plain: Sequence[tuple[int, Stratum]]) -> DataFrame:
    """Keys and stratum of a few rows of each stratum, its first ``cap`` rows in key order among them."""
    caps = {i: s.cap for i, s in plain}
    held = [f"key_{i}" for i in range(len(keys))]
    kinds = [df.schema[k].dataType for k in keys]
    # nulls come first, not-a-number last, as in Spark
    ranks = [
        F.when(c.isNull(), 0).when(F.isnan(c) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(False), 2).otherwise(1)
        for c, t in zip((col(k) for k in keys), kinds)
    ]
    fields = [T.StructField(h, t) for h, t in zip(held, kinds)] + [T.StructField(f"rank_{i}", T.IntegerType()) for i in range(len(keys))]
    order = [(f"{part}_{i}", "ascending") for i in range(len(keys)) for part in ("rank", "key")]
    columns = [f.name for f in fields]

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            row, number = pc.list_parent_indices(batch.column("strata")), pc.list_flatten(batch.column("strata"))
            for i in pc.unique(number).to_pylist():
                rows = table.select(columns).take(row.filter(pc.equal(number, i)))
                rows = pa.concat_tables([best[i], rows]) if i in best else rows
                if rows.num_rows > caps[i]:
                    rows = rows.take(pc.sort_indices(rows, sort_keys=order)[: caps[i]])
                best[i] = rows.combine_chunks()
        for i, rows in best.items():
            numbers = pa.array([[i]] * rows.num_rows, pa.list_(pa.int32()))
            yield from rows.append_column("strata", numbers).to_batches()

    schema = T.StructType([*fields, T.StructField("strata", T.ArrayType(T.IntegerType()))])
    rows = df.select(
        *[col(k).alias(h) for k, h in zip(keys, held)], *[r.alias(f"rank_{i}") for i, r in enumerate(ranks)], _strata_of(plain).alias("strata")
    )
    # what a task has kept meets the rest of its part, so the last step sees few rows of any number of tasks
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    first = rows.mapInArrow(first_rows, schema).repartition("strata", part).mapInArrow(first_rows, schema)
    return first.select(*[F.col(h).alias(k) for h, k in zip(held, keys)], F.col("strata")[0].alias("stratum"))


def _first_shuffled(df: DataFrame, keys: Sequence[str], number: int, stratum: Stratum) -> DataFrame:
    names = [col(k) for k in keys]
    rows = df.where(stratum.condition).select(*names, random_order(keys, stratum.seed).alias("shuffled"))
    first = rows.orderBy("shuffled", *names).limit(stratum.cap)
    place = F.row_number().over(Window.partitionBy(F.lit(number)).orderBy("shuffled", *names))
    return first.select(*names, F.lit(number).alias("stratum"), place.alias("at"))


def _chosen(df: DataFrame, keys: Sequence[str], strata: Sequence[Stratum], group_caps: dict[str, int], total: int):
    """Keys and reasons of the sample, at most ``total``; a row counts once."""
    reasons = F.array(*[F.lit(s.reason) for s in strata])
    groups = F.array(*[F.lit(GROUPS.index(s.group)) for s in strata])
    found = candidates(df, keys, strata).withColumns(
        {"reason": F.element_at(reasons, F.col("stratum") + 1), "grp": F.element_at(groups, F.col("stratum") + 1)}
    )
    place = F.struct("stratum", "at")
    once_per_group = found.groupBy(*[col(k) for k in keys], "grp").agg(
        F.min(place).alias("place"), F.min_by("reason", place).alias("reason")
    )
    in_group = Window.partitionBy("grp").orderBy("place", *[col(k) for k in keys])
    limits = F.element_at(F.array(*[F.lit(group_caps.get(g, total)) for g in GROUPS]), F.col("grp") + 1)
    kept = once_per_group.withColumn("n", F.row_number().over(in_group)).where(F.col("n") <= limits)
    rank = F.struct("grp", "place")
    once = kept.groupBy(*[col(k) for k in keys]).agg(F.min(rank).alias("rank"), F.min_by("reason", rank).alias("reason"))
    return once.orderBy("rank", *[col(k) for k in keys]).limit(total).drop("rank")


def take_sample(
    df: DataFrame,
    keys: Sequence[str],
    max_rows: int = V.SAMPLE_ROWS,
    seed: int = 42,
    groups: Sequence[str] = GROUPS,
    approx: bool = False,
) -> DataFrame:
    """Stratified sample with the reason of each row.

    A table of at most ``max_rows`` rows is returned whole.  Else 30% are
    random rows, 40% rows with issues and the rest contradictory rows; a row
    that belongs to several strata is taken once, for the first.  ``keys`` must
    identify a row.
    """
    if len(df.select(*[col(k) for k in keys]).limit(max_rows + 1).take(max_rows + 1)) <= max_rows:
        return df.withColumn("reason", F.lit("full_dataset"))
    n_random, n_issue = int(max_rows * 0.3), int(max_rows * 0.4)
    n_contradiction = max_rows - n_random - n_issue
    # outliers need all numeric columns, contradictions the few with a telling name
    telling = None if ISSUE in groups else rules.named_like(columns_of(df, "numeric"), V.EXTREME_NAMES)
    quartiles = quartile_pairs(df, approx, telling) if set(groups) - {RANDOM} else {}
    strata: list[Stratum] = []
    if RANDOM in groups:
        strata.append(Stratum(RANDOM, "random", F.lit(True), n_random, seed))
    if ISSUE in groups:
        strata += issue_strata(df, n_issue, seed, quartiles)
    if CONTRADICTION in groups:
        strata += contradiction_strata(df, n_contradiction, quartiles)
    if not strata:
        return df.withColumn("reason", F.lit("")).limit(0)
    caps = {RANDOM: n_random, ISSUE: n_issue}
    chosen = _chosen(df, keys, strata, caps, max_rows)
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    chosen = chosen.withColumnsRenamed(names)
    same = [col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(F.broadcast(chosen), same).drop(*names.values())  # at most max_rows rows


def sample_info(df: DataFrame, sample: DataFrame, max_rows: int = V.SAMPLE_ROWS) -> DataFrame:
    """Strategy, sizes and ratio of a sample (U4)."""
    original, sampled = df.count(), sample.count()
    strategy = "full_dataset" if original <= max_rows else "smart_sampling"
    ratio = sampled / original if original else 1.0
    return df.sparkSession.createDataFrame(
        [(strategy, original, sampled, ratio)],
        "sampling_strategy string, original_rows bigint, sampled_rows bigint, sampling_ratio double",
    )
