"""Order-based fills and ranks over a whole table, without one task for all rows.

A window without ``partitionBy`` moves every row to one task, and a window
keyed by a hot value moves that key's rows to one task.  Here the rows are first
range-partitioned and sorted by the order columns themselves, whatever their
type, with a digest of the row behind them so that repeated values are cut as
well.  Stretches of at most ``rows_per_bucket`` rows are the buckets; windows run
per bucket, and a small table with a row per bucket carries values, positions
and counts from bucket to bucket.

The placed rows are written to the shared folder, so that a lost executor cannot
draw the bounds anew.  Any bounds give the same result; they only balance the
work.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.dates import from_micros, micros
from dqspark.operators.columns import col, family, known, one_row
from dqspark.session import new_folder

ROWS_PER_BUCKET = 2_000_000
#: Range partitions; beyond them a partition holds several buckets.
MAX_PARTITIONS = 10_000
#: Rows of the carried table up to which it is sent to every task.
BROADCAST_ROWS = 100_000

BUCKET = "__bucket"
PLACE = "__place"
TIE = "__tie"
POSITION = "__position"
FORWARD, BACKWARD, LINEAR = "forward_fill", "backward_fill", "interpolate"


def tie_breaker(df: DataFrame) -> Column:
    """A digest of the row, so that rows with equal order values have an order that repeats."""
    return F.xxhash64(*[col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()])


def cut_in_order(df: DataFrame, order: Sequence[Column], n: int, rows_per_bucket: int) -> DataFrame:
    """Stored rows with ``PLACE``, rising along ``order``, and ``BUCKET``, a stretch of it."""
    parts = max(1, min(MAX_PARTITIONS, math.ceil(n / rows_per_bucket)))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn(PLACE, F.monotonically_increasing_id())
    # the number holds the partition above its 33rd bit and the row below it
    within = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    bucket = F.col(PLACE) - within + F.floor(within / F.lit(rows_per_bucket))
    placed = placed.withColumn(BUCKET, bucket.cast("bigint"))
    folder = new_folder(df.sparkSession)
    placed.write.parquet(folder)
    return df.sparkSession.read.schema(placed.schema).parquet(folder)


def _segments(
    df: DataFrame, order_by: Sequence[str], keys: Sequence[str], rows_per_bucket: int
) -> tuple[DataFrame, bool]:
    """Buckets for the rows that need them; False when one window per key is safe."""
    tied = df.withColumn(TIE, tie_breaker(df))
    whole = tied.withColumn(BUCKET, F.lit(0).cast("bigint")).withColumn(PLACE, F.lit(0).cast("bigint"))
    n = df.count()
    if n <= rows_per_bucket:
        return whole, False
    if keys:
        counts = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("__n"))
        if not one_row(counts, {"n": F.max("__n") > rows_per_bucket})["n"]:
            return whole, False
    order = [col(k).asc() for k in keys] + [col(c).asc() for c in order_by] + [F.col(TIE).asc()]
    return cut_in_order(tied, order, n, rows_per_bucket), True


def fill_ordered(
    df: DataFrame,
    fills: Mapping[str, str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Fill gaps along an order (W1-W4), several columns in one pass.

    ``fills`` maps a column to ``forward_fill`` (leading gaps stay),
    ``backward_fill`` (trailing gaps stay) or ``interpolate`` (linear by row
    position; leading gaps stay, trailing gaps take the last value).  The order
    columns together should be unique, else ties are filled in any order.
    """
    if not order_by:
        raise ValueError("an order-based fill needs order_by columns")
    order_by, keys = list(order_by), list(partition_by)
    unknown = sorted(set(fills.values()) - {FORWARD, BACKWARD, LINEAR})
    if unknown:
        raise ValueError(f"unknown ordered fill: {unknown}")
    names = df.columns
    placed, cut = _segments(df, order_by, keys, rows_per_bucket)

    order = [F.col(PLACE)] if cut else [*[col(c) for c in order_by], F.col(TIE)]
    forward = Window.partitionBy(*[col(k) for k in keys], BUCKET).orderBy(*[c.asc() for c in order])
    backward = Window.partitionBy(*[col(k) for k in keys], BUCKET).orderBy(*[c.desc() for c in order])
    so_far = (Window.unboundedPreceding, Window.currentRow)
    value = {c: _fill_value(df, c, how) for c, how in fills.items()}
    needs_next = [c for c, how in fills.items() if how != FORWARD]
    needs_last = [c for c, how in fills.items() if how != BACKWARD]

    # Known values with their row position; a struct is NULL where nothing is known.
    # Only interpolation needs positions.
    linear = LINEAR in fills.values()
    position = F.row_number().over(forward).cast("bigint") if linear else F.lit(0).cast("bigint")
    here = placed.withColumn(POSITION, position)
    marks = {
        c: F.when(value[c].isNotNull(), F.struct(value[c].alias("v"), F.col(POSITION).alias("p"))) for c in fills
    }
    here = here.withColumns(
        {f"__last_{i}": F.last(marks[c], ignorenulls=True).over(forward.rowsBetween(*so_far))
         for i, c in enumerate(fills) if c in needs_last}
    )
    here = here.withColumns(
        # "next known" as "last known" in descending order: the frame that looks
        # ahead to the end of the partition costs quadratic time.
        {f"__next_{i}": F.last(marks[c], ignorenulls=True).over(backward.rowsBetween(*so_far))
         for i, c in enumerate(fills) if c in needs_next}
    )
    if cut:
        here = _carry(here, marks, fills, keys)

    filled = {}
    for i, (c, how) in enumerate(fills.items()):
        if how == FORWARD:
            guess = F.col(f"__last_{i}.v")
        elif how == BACKWARD:
            guess = F.col(f"__next_{i}.v")
        else:
            last, nxt = F.col(f"__last_{i}"), F.col(f"__next_{i}")
            slope = (nxt["v"] - last["v"]) / F.nullif(nxt["p"] - last["p"], F.lit(0))
            line = last["v"] + slope * (F.col(POSITION) - last["p"])
            guess = _from_fill_value(df, c, F.coalesce(F.when(nxt.isNotNull(), line), last["v"]))
        filled[c] = F.when(known(df, c).isNotNull(), _keep_type(df, c, how)).otherwise(guess)
    return here.select(*[filled[c].alias(c) if c in filled else col(c) for c in names])


def _fill_value(df: DataFrame, name: str, how: str) -> Column:
    if how != LINEAR:
        return known(df, name)
    data_type = df.schema[name].dataType
    kind = family(data_type)
    if kind == "datetime":
        return micros(col(name), data_type).cast("double")
    if kind == "numeric":
        return known(df, name).cast("double")
    raise ValueError(f"cannot interpolate {name}: {data_type.simpleString()}")


def _from_fill_value(df: DataFrame, name: str, guess: Column) -> Column:
    data_type = df.schema[name].dataType
    if family(data_type) == "datetime":
        return from_micros(F.round(guess).cast("bigint"), data_type)
    return guess


def _keep_type(df: DataFrame, name: str, how: str) -> Column:
    if how == LINEAR and isinstance(df.schema[name].dataType, T.NumericType):
        return col(name).cast("double")
    return col(name)


def _carry(
    here: DataFrame, marks: Mapping[str, Column], fills: Mapping[str, str], keys: list[str]
) -> DataFrame:
    """Bring in what earlier and later buckets know, and global positions.

    First and last known values per bucket come from an aggregate that is
    combined before its shuffle, and without positions it needs no sort.
    """
    ends = []
    for i, c in enumerate(fills):
        # value and position apart, as a struct would make the aggregate sort
        value, place = marks[c]["v"], F.when(marks[c].isNotNull(), F.col(POSITION))
        at = F.when(marks[c].isNotNull(), F.col(PLACE))
        end_value, start_value = F.max_by(value, at), F.min_by(value, at)
        ends += [end_value.alias(f"__end_v_{i}"), F.max(place).alias(f"__end_p_{i}")]
        ends += [start_value.alias(f"__start_v_{i}"), F.min(place).alias(f"__start_p_{i}")]
    per_bucket = here.groupBy(*[col(k).alias(f"__k_{j}") for j, k in enumerate(keys)], F.col(BUCKET).alias("__b"))
    table = per_bucket.agg(F.count("*").alias("__n"), *ends)

    by_key = Window.partitionBy(*([f"__k_{j}" for j in range(len(keys))] or [F.lit(0)]))
    earlier = by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))

    def end(name: str, i: int) -> Column:
        known_end = F.struct(F.col(f"__{name}_v_{i}").alias("v"), (F.col(f"__{name}_p_{i}") + F.col("__offset")).alias("p"))
        return F.when(F.col(f"__{name}_p_{i}").isNotNull(), known_end)

    def shifted(name: str) -> Column:
        offset = F.coalesce("__offset", F.lit(0))
        moved = F.struct(F.col(f"{name}.v").alias("v"), (F.col(f"{name}.p") + offset).alias("p"))
        return F.when(F.col(name).isNotNull(), moved)

    carried = {}
    for i in range(len(fills)):
        carried[f"__before_{i}"] = F.last(end("end", i), ignorenulls=True).over(earlier)
        carried[f"__after_{i}"] = F.last(end("start", i), ignorenulls=True).over(later)
    kept = [f"__k_{j}" for j in range(len(keys))] + ["__b", "__offset"]
    # Only a key that lies in several buckets has anything to carry: a row or two for each bucket.
    table = table.withColumn("__buckets", F.count("*").over(by_key)).where(F.col("__buckets") > 1)
    table = table.withColumns(carried).select(*kept, *carried)
    folder = new_folder(here.sparkSession)
    table.write.parquet(folder)
    table = here.sparkSession.read.schema(table.schema).parquet(folder)
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)

    same = [col(k).eqNullSafe(F.col(f"__k_{j}")) for j, k in enumerate(keys)] + [F.col(BUCKET) == F.col("__b")]
    joined = here.join(table, same, "left")
    cols = {}
    for i in range(len(fills)):
        for own, carry in ((f"__last_{i}", f"__before_{i}"), (f"__next_{i}", f"__after_{i}")):
            if own in here.columns:
                cols[own] = F.coalesce(shifted(own), F.col(carry))
    cols[POSITION] = F.col(POSITION) + F.coalesce("__offset", F.lit(0))
    return joined.withColumns(cols)


def rank_rows(
    df: DataFrame, by: str, descending: bool = True, out: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Standard rank of every row over the whole table (A32); missing values last.

    The column is ordered as it is, numbers, dates or texts.  Where one window is
    too much, rows are cut in order; a value that goes on over buckets takes the
    rank of its first row from the first of them.
    """
    n = df.count()
    value = known(df, by)
    better = value.desc_nulls_last() if descending else value.asc_nulls_last()
    if n <= rows_per_bucket:
        return df.withColumn(out, F.rank().over(Window.partitionBy(F.lit(0)).orderBy(better)).cast("bigint"))
    tied = df.withColumn(TIE, tie_breaker(df))
    placed = cut_in_order(tied, [better, F.col(TIE).asc()], n, rows_per_bucket)
    value = known(placed, by)
    at = F.col(PLACE)
    ends = placed.groupBy(F.col(BUCKET).alias("__b")).agg(
        F.count("*").alias("__n"), F.min_by(F.struct(value.alias("v")), at)["v"].alias("__first"),
        F.max_by(F.struct(value.alias("v")), at)["v"].alias("__end"),
    )
    local = F.rank().over(Window.partitionBy(BUCKET).orderBy(better))
    ranked = placed.withColumn(out, local)
    starts = ranked.groupBy(F.col(BUCKET).alias("__b")).agg(F.max(out).alias("__start"))  # rank of the last value
    by_bucket = Window.partitionBy(F.lit(0)).orderBy("__b")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    table = ends.join(starts, "__b").withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    goes_on = F.col("__first").eqNullSafe(F.lag("__end").over(by_bucket)) & (F.row_number().over(by_bucket) > 1)
    table = table.withColumn("__goes_on", goes_on)
    all_of_it = F.col("__goes_on") & F.col("__first").eqNullSafe(F.col("__end"))
    table = table.withColumn("__began", F.when(~all_of_it, F.col("__offset") + F.col("__start")))
    table = table.withColumn("__carried", F.last("__began", ignorenulls=True).over(before))
    table = table.select("__b", "__offset", "__first", "__goes_on", "__carried")
    if n / rows_per_bucket <= BROADCAST_ROWS / 2:
        table = F.broadcast(table)  # a row per bucket
    joined = ranked.join(table, F.col(BUCKET) == F.col("__b"))
    carried = F.col("__goes_on") & known(placed, by).eqNullSafe(F.col("__first"))
    total = F.when(carried, F.col("__carried")).otherwise(F.col(out) + F.col("__offset")).cast("bigint")
    return joined.withColumn(out, total).select(*[col(c) for c in df.columns], F.col(out))
