"""Profiles of a table: sizes, missing values, column metadata, comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.functions.text import percent_text
from dqspark.operators import stats
from dqspark.operators.columns import col, columns_of, family, known, missing_count, one_row


def _total_missing(df: DataFrame, names: Sequence[str]) -> Column:
    return F.coalesce(F.sum(missing_count(df, names).cast("bigint")), F.lit(0)).cast("bigint")


def table_profile(df: DataFrame, status: str = "flag_status") -> DataFrame:
    """Rows, columns and missing cells of a table, in one aggregate (A1)."""
    names = [c for c in df.columns if c != status]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        _total_missing(df, names).alias("n_missing"),
    )


def stage_compare(stages: Mapping[str, DataFrame], status: str = "flag_status") -> DataFrame:
    """One profile row per stage, with flagged rows where there is a status (A2)."""

    def one(position: int, name: str, df: DataFrame) -> DataFrame:
        flagged = F.count_if(col(status) > 0) if status in df.columns else F.lit(None)
        names = [c for c in df.columns if c != status]
        return df.agg(
            F.lit(position).alias("position"),
            F.lit(name).alias("stage"),
            F.count("*").alias("n_rows"),
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            _total_missing(df, names).alias("n_missing"),
            flagged.cast("bigint").alias("flagged_rows"),
        )

    return reduce(DataFrame.unionByName, [one(i, n, d) for i, (n, d) in enumerate(stages.items(), start=1)])


#: Texts of up to so many bytes stand for themselves among the digests.
DIGEST_BYTES = 16
#: Base-2 logarithm of the entries of a distinct sketch; it is exact up to about that many values.
SKETCH_LOG = 12


def digest(value: Column) -> Column:
    """A value as at most 17 bytes: short texts as they are, longer ones by a 128-bit digest.

    A digest has one byte more than any short text, so the two never meet; two
    long values share one with a probability of 2^-128 a pair.
    """
    text = value.cast("string")
    whole = F.octet_length(text) <= DIGEST_BYTES
    return F.when(whole, text.cast("binary")).otherwise(F.concat(F.lit(b"\x00"), F.unhex(F.md5(text.cast("binary")))))


def distinct_counts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Exact number of distinct values of several columns: (column, n_distinct).

    One shuffle serves all columns; digests travel, no texts, and equal ones are
    taken together before.
    """
    names = list(names)
    pairs = [F.struct(F.lit(i).alias("at"), digest(known(df, c)).alias("digest")) for i, c in enumerate(names)]
    rows = df.select(F.inline(F.array(*pairs))).where("digest IS NOT NULL").groupBy("at", "digest").agg(F.lit(1).alias("one"))
    listed = F.array(*[F.lit(c) for c in names])
    counted = rows.groupBy("at").agg(F.count("*").alias("n_distinct"))
    return counted.select(F.element_at(listed, F.col("at") + 1).alias("column"), "n_distinct")


def smallest_values(df: DataFrame, names: Sequence[str], samples: int) -> dict[str, list[str]]:
    """The smallest distinct values of several columns, as texts.

    A round is one aggregate that gives the next value of every column: no text
    is shuffled but the smallest ones of the tasks.
    """
    found: dict[str, list[str]] = {c: [] for c in names}
    live = list(names)
    for _ in range(samples):
        wanted = {}
        for i, c in enumerate(live):
            v = known(df, c).cast("string")
            wanted[f"m_{i}"] = F.min(F.when(v > F.lit(found[c][-1]), v) if found[c] else v)
        got = one_row(df, wanted)
        live, before = [], live
        for i, c in enumerate(before):
            if got[f"m_{i}"] is not None:
                found[c].append(got[f"m_{i}"])
                live.append(c)
        if not live:
            break
    return found


def _distinct_and_samples(
    df: DataFrame, names: Sequence[str], samples: int, sample_of: Sequence[str] | None = None
) -> DataFrame:
    """Distinct count per column and the smallest values of the columns in ``sample_of`` (else of all)."""
    values = smallest_values(df, list(names if sample_of is None else sample_of), samples)
    small = df.sparkSession.createDataFrame(list(values.items()), "__c string, samples array<string>")
    return distinct_counts(df, names).join(small, F.col("column") == F.col("__c"), "left").drop("__c")


def distinct_sketches(df: DataFrame, names: Iterable[str], log_entries: int = SKETCH_LOG) -> DataFrame:
    """A theta sketch of the distinct values of each column: (column, n, sketch), to be stored and merged."""
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.count(known(df, c)).alias("n"),
            F.theta_sketch_agg(digest(known(df, c)), F.lit(log_entries)).alias("sketch"),
        )
        for c in names
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def merge_sketches(sketches: DataFrame, log_entries: int = SKETCH_LOG) -> DataFrame:
    """Sketches of parts of a table, or of several days, as those of the whole: one row per column."""
    return sketches.groupBy("column").agg(
        F.sum("n").alias("n"), F.theta_union_agg("sketch", F.lit(log_entries)).alias("sketch")
    )


def compare_sketches(before: DataFrame, after: DataFrame, log_entries: int = SKETCH_LOG) -> DataFrame:
    """Distinct values per column before and after a stage, and how many were kept, lost and new (A2).

    Only the stored sketches are read.  Exact up to ``2 ** log_entries`` values, else estimates.
    """
    a = before.select("column", F.col("sketch").alias("a"))
    b = after.select("column", F.col("sketch").alias("b"))

    def size(sketch: Column) -> Column:
        return F.theta_sketch_estimate(sketch)

    return a.join(b, "column").select(
        "column",
        size(F.col("a")).alias("distinct_before"),
        size(F.col("b")).alias("distinct_after"),
        size(F.theta_intersection("a", "b")).alias("kept"),
        size(F.theta_difference("a", "b")).alias("lost"),
        size(F.theta_difference("b", "a")).alias("new"),
        size(F.theta_union("a", "b", F.lit(log_entries))).alias("distinct_either"),
    )


def missing_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Columns with missing values: count, share, type, distinct values, smallest
    values as samples, and the suggested strategy (A3, A4)."""
    first = {"n": F.count("*")}
    for i, f in enumerate(df.schema):
        v = known(df, f.name)
        first[f"k_{i}"] = F.count(v)
        if family(f.dataType) == "numeric":
            first[f"s_{i}"] = stats.skewness(v.cast("double"), F.count(v))
    got = one_row(df, first)
    rows = []
    for i, f in enumerate(df.schema):
        present, missing = got[f"k_{i}"], got["n"] - got[f"k_{i}"]
        if missing:
            rows.append((f.name, f.dataType.simpleString(), family(f.dataType), missing,
                         100.0 * missing / got["n"], present, got.get(f"s_{i}")))
    names = [r[0] for r in rows]
    base = df.sparkSession.createDataFrame(
        rows,
        "column string, dtype string, family string, missing_count bigint, missing_pct double, "
        "present bigint, skewness double",
    )
    none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    if names:
        found = _distinct_and_samples(df, names, samples).withColumnRenamed("column", "__c")
        base = base.join(found, F.col("column") == F.col("__c"), "left")
        none = F.coalesce("n_distinct", none[0]), F.coalesce("samples", none[1])
    return base.withColumns({"n_distinct": none[0], "samples": none[1]}).select(
        "column", "dtype", "missing_count", "missing_pct", percent_text(F.col("missing_pct")).alias("missing_pct_text"),
        "n_distinct", "samples", "skewness", suggestion().alias("suggested_strategy"),
    )


def suggestion() -> Column:
    """Suggested strategy from family, missing_pct, present, skewness and n_distinct (A4)."""
    says = {k: F.lit(v) for k, v in V.SUGGESTIONS.items()}
    kind, pct = F.col("family"), F.col("missing_pct")
    numeric = kind.isin("numeric", "boolean")
    return (
        F.when(pct > V.HIGH_MISSING_PCT, says["drop"])
        .when((pct < V.LOW_MISSING_PCT) & numeric, says["median_low"])
        .when(pct < V.LOW_MISSING_PCT, says["mode_low"])
        .when(numeric & (F.col("present") <= 3), says["median_few"])
        .when(numeric & (F.abs(F.col("skewness")) < V.SKEW_LIMIT), says["mean"])
        .when(numeric, says["median_skewed"])
        .when((kind == "text") & (F.try_divide(F.col("n_distinct"), F.col("present")) < V.LOW_CARDINALITY),
              says["mode_text"])
        .when(kind == "text", says["constant"])
        .when(kind == "datetime", says["datetime"])
        .otherwise(says["default"])
    )


#: Bits of a word of a row's null bitmap, and rows of bitmaps multiplied at once.
WORD_BITS = 62
PRODUCT_ROWS = 4096


def missing_patterns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Which columns are missing together: a bitmap of words per pattern, with its rows (``words``, ``n``)."""
    words = []
    for start in range(0, len(names), WORD_BITS):
        bits = [F.when(known(df, c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(names[start : start + WORD_BITS])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), [b.cast("bigint") for b in bits]))
    return df.select(F.array(*words).alias("words")).groupBy("words").agg(F.count("*").alias("n"))


def missing_correlation(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Column pairs whose missing values go together (A5).

    The correlation of two null indicators needs four counts.  Columns that are
    never or always missing correlate with nothing and are left out first.  Rows
    are grouped by their null bitmap, and how often two columns are missing
    together is a product of the matrix of distinct bitmaps with itself, taken in
    blocks of rows; a table of a thousand columns needs no expression per pair.
    """
    first = one_row(df, {"n": F.count("*"), **{f"k_{i}": F.count(known(df, c)) for i, c in enumerate(df.columns)}})
    n = first["n"]
    gaps = {c: n - first[f"k_{i}"] for i, c in enumerate(df.columns)}
    names = [c for c in df.columns if 0 < gaps[c] < n]
    schema = "column1 string, column2 string, correlation double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    k = len(names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k), np.int64)
        shift = np.arange(WORD_BITS)
        for batch in batches:
            for start in range(0, batch.num_rows, PRODUCT_ROWS):
                part = batch.slice(start, PRODUCT_ROWS)
                words = part.column("words").flatten().to_numpy().reshape(part.num_rows, -1)
                bits = ((words[:, :, None] >> shift) & 1).reshape(part.num_rows, -1)[:, :k].astype(np.float64)
                rows = part.column("n").to_numpy().astype(np.float64)
                total += np.rint(bits.T @ (bits * rows[:, None])).astype(np.int64)
        a, b = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b], pa.int64())], ["a", "b", "both"]
        )

    both = (
        missing_patterns(df, names).mapInArrow(together, "a int, b int, both bigint")
        .groupBy("a", "b").agg(F.sum("both").alias("both"))
    )
    # pairs that are never missing together correlate below zero, so they are all looked at
    places = df.sparkSession.createDataFrame([(i, c, gaps[c]) for i, c in enumerate(names)], "i int, c string, g bigint")
    x = places.select(F.col("i").alias("a"), F.col("c").alias("column1"), F.col("g").cast("double").alias("g1"))
    y = places.select(F.col("i").alias("b"), F.col("c").alias("column2"), F.col("g").cast("double").alias("g2"))
    pairs = x.join(y, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    spread = F.sqrt(F.col("g1") * (n - F.col("g1"))) * F.sqrt(F.col("g2") * (n - F.col("g2")))
    value = (F.lit(float(n)) * F.coalesce("both", F.lit(0)) - F.col("g1") * F.col("g2")) / spread
    return (
        pairs.withColumn("correlation", value).where(F.abs("correlation") > threshold)
        .orderBy("a", "b").select("column1", "column2", "correlation")
    )


def missing_rows(df: DataFrame) -> DataFrame:
    """Rows with more than one missing value, and rows with nothing else."""
    gaps = missing_count(df)
    return df.agg(
        F.count_if(gaps > 1).alias("rows_multiple_missing"),
        F.count_if(gaps == len(df.columns)).alias("completely_empty_rows"),
    )


def mostly_missing_rows(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Rows in which more than ``share`` of the columns are missing."""
    return df.where(missing_count(df) > len(df.columns) * share)


def column_info(df: DataFrame, samples: int = 3, approx: bool = False) -> DataFrame:
    """Per column: type, missing and distinct count; numbers: min, max, mean;
    texts: the smallest distinct values (A12, A13)."""
    stats_rows = []
    for i, f in enumerate(df.schema):
        v = known(df, f.name)
        numeric = family(f.dataType) in ("numeric", "boolean")
        number = v.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else v.cast("double")
        none = F.lit(None).cast("double")
        stats_rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.count_if(v.isNull()).alias("null_count"),
                (F.approx_count_distinct(v) if approx else F.lit(None).cast("bigint")).alias("estimate"),
                (F.min(number) if numeric else none).alias("min"),
                (F.max(number) if numeric else none).alias("max"),
                (F.avg(number) if numeric else none).alias("mean"),
            )
        )
    base = df.agg(F.array(*stats_rows).alias("r")).select(F.inline("r"))
    texts = columns_of(df, "text")
    if approx:
        if not texts:
            return base.withColumn("samples", F.lit(None).cast("array<string>")).withColumnRenamed(
                "estimate", "unique_count")
        found = df.sparkSession.createDataFrame(
            list(smallest_values(df, texts, samples).items()), "__c string, samples array<string>"
        )
        joined = base.join(found, F.col("column") == F.col("__c"), "left").drop("__c")
        return joined.withColumnRenamed("estimate", "unique_count")
    found = _distinct_and_samples(df, df.columns, samples, texts).withColumnRenamed("column", "__c")
    joined = base.join(found, F.col("column") == F.col("__c"), "left")
    return joined.select(
        "position", "column", "dtype", "null_count",
        F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("unique_count"), "min", "max", "mean",
        F.when(F.col("dtype") == "string", F.col("samples")).alias("samples"),
    )


def quartiles(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Quartiles, median, 1.5 x IQR fences and the 10 x Q3 ceiling per column."""
    names = columns_of(df, "numeric") if columns is None else columns
    found = stats.quantiles(df, {c: [0.25, 0.5, 0.75] for c in names}, approx)
    rows = []
    for c, (q1, median, q3) in found.items():
        if q1 is None:
            rows.append((c, None, None, None, None, None, None))
        else:
            reach = 1.5 * (q3 - q1)
            rows.append((c, q1, median, q3, q1 - reach, q3 + reach, q3 * 10))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, q1 double, median double, q3 double, low_fence double, high_fence double, ceiling double",
    )


def validate_imputation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column: missing before and after, whether filled fully or in part, and
    whether numbers left their original range (A22)."""

    def measured(df: DataFrame, side: str) -> DataFrame:
        rows = []
        for i, f in enumerate(before.schema):
            v = known(df, f.name)
            numeric = isinstance(f.dataType, T.NumericType)
            none = F.lit(None).cast("double")
            rows.append(
                F.struct(
                    F.lit(i).alias(f"position_{side}"),
                    F.lit(f.name).alias(f"column_{side}"),
                    F.count_if(v.isNull()).alias(f"missing_{side}"),
                    (F.min(v.cast("double")) if numeric else none).alias(f"min_{side}"),
                    (F.max(v.cast("double")) if numeric else none).alias(f"max_{side}"),
                )
            )
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    a, b = measured(before, "before"), measured(after, "after")
    joined = a.join(b, F.col("position_before") == F.col("position_after"))
    was, now = F.col("missing_before"), F.col("missing_after")
    filled = (
        F.when((was > 0) & (now == 0), "fully")
        .when((was > 0) & (now < was), "partially")
        .when(was > 0, "not")
        .otherwise("complete before")
    )
    outside = (F.col("min_after") < F.col("min_before")) | (F.col("max_after") > F.col("max_before"))
    return joined.select(
        F.col("column_before").alias("column"), was, now, (was - now).alias("missing_reduction"),
        filled.alias("filled"), F.coalesce(outside, F.lit(False)).alias("outside_range"),
        "min_before", "max_before", "min_after", "max_after",
    )


def imputation_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: missing cells before and after, their reduction, and the columns filled fully, in part or beyond range."""
    checked = validate_imputation(before, after)

    def listed(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("column"))))

    return checked.agg(
        F.sum("missing_before").alias("total_missing_before"),
        F.sum("missing_after").alias("total_missing_after"),
        F.sum("missing_reduction").alias("missing_reduction"),
        listed(F.col("filled") == "fully").alias("columns_fully_imputed"),
        listed(F.col("filled") == "partially").alias("columns_partially_imputed"),
        listed(F.col("outside_range")).alias("columns_outside_range"),
    )
