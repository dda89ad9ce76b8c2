"""Declared questions: grouped counts, averages, rates, time buckets, rankings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.coerce import to_time
from dqspark.functions.dates import BUCKETS, NUMBER_BUCKETS
from dqspark.operators.columns import col, columns_of, family
from dqspark.operators.ordered import ROWS_PER_BUCKET, rank_rows
from dqspark.session import new_folder

DESCENDING, ASCENDING = "descending", "ascending"


@dataclass(frozen=True)
class Metric:
    """A figure per group.

    ``kind`` is count, avg, sum, min, max, distinct, rate, first_at (the value
    of ``column`` where ``by`` is smallest) or last_at (largest).  A rate is the
    percentage of rows that meet ``condition``, a SQL expression.
    """

    name: str
    kind: str
    column: str | None = None
    condition: str | None = None
    by: str | None = None

    def expression(self) -> Column:
        if self.kind == "count":
            counted = F.count("*") if self.column is None else F.count(col(self.column))
            return counted.alias(self.name)
        if self.kind == "rate":
            share = F.try_divide(F.count_if(F.expr(self.condition)).cast("double"), F.count("*"))
            return F.round(share * 100, 2).alias(self.name)
        if self.kind in ("first_at", "last_at"):
            pick = F.min_by if self.kind == "first_at" else F.max_by
            return pick(col(self.column), col(self.by)).alias(self.name)
        kinds = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.count_distinct}
        if self.kind not in kinds:
            raise ValueError(f"unknown metric {self.kind!r}")
        return kinds[self.kind](col(self.column)).alias(self.name)


@dataclass(frozen=True)
class AnalysisSpec:
    """A question about one table.

    ``time_bucket`` is month (all years together), year_month, week, weekday,
    year, day or a span such as ``6 hours``.  ``order`` sorts by ``order_by`` or
    else by the first metric.  ``ranked`` adds the rank of every group and marks
    the top ones; the table stays complete (A32).
    """

    metrics: Sequence[Metric]
    group_by: Sequence[str] = ()
    time_column: str | None = None
    time_bucket: str | None = None
    where: str | None = None
    order: str | None = None
    order_by: str | None = None
    ranked: bool = False
    limit: int | None = None
    rows_per_bucket: int = ROWS_PER_BUCKET


def answer(df: DataFrame, spec: AnalysisSpec, status: str = "flag_status") -> DataFrame:
    """The answer table of a question.

    The status column takes no part.  ``ranked`` writes the grouped table to the
    shared folder, as ranks over many groups look at it more than once.
    """
    df = df.drop(status)
    if spec.where:
        df = df.where(F.expr(spec.where))
    keys = [col(c) for c in spec.group_by]
    position = None
    if spec.time_bucket:
        time = to_time(col(spec.time_column))
        if spec.time_bucket in NUMBER_BUCKETS and family(df.schema[spec.time_column].dataType) == "numeric":
            keys.append(NUMBER_BUCKETS[spec.time_bucket](col(spec.time_column)).alias(spec.time_bucket))
            position = "__position"
            keys.append(col(spec.time_column).alias(position))
        elif spec.time_bucket in BUCKETS:
            name_of, place_of = BUCKETS[spec.time_bucket]
            keys.append(name_of(time).alias(spec.time_bucket))
            if place_of is not None:
                position = "__position"
                keys.append(place_of(time).alias(position))
        else:
            keys.append(F.window(time, spec.time_bucket)["start"].alias("period_start"))
    grouped = df.groupBy(*keys).agg(*[m.expression() for m in spec.metrics])
    first = spec.order_by or spec.metrics[0].name
    if spec.ranked:
        folder = new_folder(df.sparkSession)  # read twice below: counted, then ranked
        grouped.write.parquet(folder)
        grouped = df.sparkSession.read.schema(grouped.schema).parquet(folder)
        grouped = rank_rows(grouped, first, spec.order != ASCENDING, rows_per_bucket=spec.rows_per_bucket)
        grouped = grouped.withColumn("is_top", F.col("rank") == 1)
    if spec.order:
        ordered = order_result(grouped, spec.order, first)
    elif position:
        ordered = grouped.orderBy(position)
    else:
        ordered = grouped
    ordered = ordered.drop("__position")
    return ordered if spec.limit is None else ordered.limit(spec.limit)


def order_result(df: DataFrame, order: str | None, by: str | None = None) -> DataFrame:
    """Sort an answer by a column, else by its first numeric one; nulls last (K1)."""
    numeric = columns_of(df, "numeric")
    by = by or (numeric[0] if numeric else None)
    if order is None or by is None:
        return df
    rest = [col(c).asc_nulls_last() for c in df.columns if c != by and not c.startswith("__")]
    first = col(by).desc_nulls_last() if order == DESCENDING else col(by).asc_nulls_last()
    return df.orderBy(first, *rest)


def order_of(question: str) -> str | None:
    """The order a question asks for; words are looked for as parts of the text."""
    text = question.lower()
    if any(w in text for w in V.DESCENDING_WORDS):
        return DESCENDING
    if any(w in text for w in V.ASCENDING_WORDS):
        return ASCENDING
    return None


def month_bucket_of(question: str) -> str:
    """Months of all years together, unless the question names a year."""
    return "year_month" if re.search(r"\b(19|20)\d\d\b", question) else "month"


def popular(df: DataFrame, column: str, most: bool = True, ranked: bool = True) -> DataFrame:
    """All values of a column by how common they are."""
    spec = AnalysisSpec([Metric("n", "count")], [column], order=DESCENDING if most else ASCENDING, ranked=ranked)
    return answer(df, spec)
