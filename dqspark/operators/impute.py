"""Missing-value fills: plan strategies, fit all statistics together, fill.

``fit`` reads the table, ``FittedFill.transform`` is one projection (plus the
order-based fills of :mod:`dqspark.operators.ordered`).  A fitted fill made of
statistics only also runs on a streaming DataFrame.
"""

from __future__ import annotations

import enum
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.functions.coerce import to_number, to_time
from dqspark.functions.text import percent_text
from dqspark.operators import ordered, stats
from dqspark.operators.columns import boolean_like, col, columns_of, datetime_like, family, known, one_row


class Strategy(str, enum.Enum):
    """How to fill a column (M6)."""

    MEAN = "mean"
    MEDIAN = "median"
    MODE = "mode"
    FORWARD_FILL = "forward_fill"
    BACKWARD_FILL = "backward_fill"
    INTERPOLATE = "interpolate"
    CONSTANT = "constant"
    DROP = "drop"
    SKIP = "skip"


ORDERED = (Strategy.FORWARD_FILL, Strategy.BACKWARD_FILL, Strategy.INTERPOLATE)
ALLOWED = {
    "numeric": set(Strategy),
    "text": set(Strategy) - {Strategy.MEAN, Strategy.MEDIAN, Strategy.INTERPOLATE},
    "boolean": set(Strategy) - {Strategy.MEAN, Strategy.MEDIAN, Strategy.INTERPOLATE},
    "datetime": {*ORDERED, Strategy.DROP, Strategy.SKIP},
    "other": {Strategy.DROP, Strategy.SKIP},
}
DEFAULTS = {
    "numeric": Strategy.MEDIAN,
    "text": Strategy.MODE,
    "boolean": Strategy.CONSTANT,
    "datetime": Strategy.FORWARD_FILL,
    "other": Strategy.SKIP,
}
CONSTANTS = {"numeric": 0, "text": V.UNKNOWN_TEXT, "boolean": False}

REPORT_SCHEMA = (
    "column string, missing_before bigint, missing_pct double, missing_pct_text string, "
    "missing_after bigint, strategy string, value string, success boolean, error string"
)


@dataclass(frozen=True)
class ColumnFill:
    column: str
    strategy: Strategy
    missing: int
    value: object = None
    success: bool = True
    error: str = ""


@dataclass(frozen=True)
class FittedFill:
    """Fills found by :func:`fit`, ready to apply."""

    rows: int
    fills: tuple[ColumnFill, ...]
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    rows_per_bucket: int = ordered.ROWS_PER_BUCKET

    def transform(self, df: DataFrame) -> DataFrame:
        active = [f for f in self.fills if f.success and f.strategy is not Strategy.SKIP]
        dropped = [known(df, f.column).isNotNull() for f in active if f.strategy is Strategy.DROP]
        for condition in dropped:
            df = df.where(condition)
        along = {f.column: f.strategy.value for f in active if f.strategy in ORDERED}
        if along:
            df = ordered.fill_ordered(df, along, self.order_by, self.partition_by, self.rows_per_bucket)
        constant = {f.column: _filled(df, f) for f in active if f.strategy not in (*ORDERED, Strategy.DROP)}
        return df.withColumns(constant) if constant else df

    def report(self, spark: SparkSession, after: DataFrame | None = None) -> DataFrame:
        """One row per column with missing values.

        ``after`` is the filled table; with it the report also says how many
        values are still missing.
        """
        left = {}
        if after is not None:
            left = one_row(after, {f.column: F.count_if(known(after, f.column).isNull()) for f in self.fills})
        rows = []
        for f in self.fills:
            pct = 100.0 * f.missing / self.rows if self.rows else None
            shown = f.strategy.value if f.strategy in ORDERED else f.value
            rows.append(
                (f.column, f.missing, pct, None, left.get(f.column), f.strategy.value,
                 None if shown is None else str(shown), f.success, f.error)
            )
        return spark.createDataFrame(rows, REPORT_SCHEMA).withColumn(
            "missing_pct_text", percent_text(F.col("missing_pct"))
        )


def _filled(df: DataFrame, fill: ColumnFill) -> Column:
    data_type = df.schema[fill.column].dataType
    fractional = fill.strategy in (Strategy.MEAN, Strategy.MEDIAN) and isinstance(data_type, T.NumericType)
    target = T.DoubleType() if fractional else data_type
    return F.coalesce(known(df, fill.column).cast(target), F.lit(fill.value).cast(target))


def check_strategies(df: DataFrame, strategies: Mapping[str, Strategy], order_by: Sequence[str]) -> None:
    """Raise for strategies that make no sense, before any job runs."""
    for name, strategy in strategies.items():
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
        kind = family(df.schema[name].dataType)
        if strategy not in ALLOWED[kind]:
            raise ValueError(f"{strategy.value} does not apply to {kind} column {name!r}")
        if strategy in ORDERED and not order_by:
            raise ValueError(f"{strategy.value} of {name!r} needs order_by columns")


def fit(
    df: DataFrame,
    strategies: Mapping[str, Strategy | str],
    constants: Mapping[str, object] | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    approx: bool = False,
    distinct_limit: int = stats.DISTINCT_LIMIT,
    rows_per_bucket: int = ordered.ROWS_PER_BUCKET,
) -> FittedFill:
    """Find the fill values of the given columns.

    One aggregate counts missing values and gives the means; a second one gives
    medians and modes of all columns together.  A column without missing values
    is left out of the plan and the report.
    """
    strategies = {c: Strategy(s) for c, s in strategies.items()}
    constants = dict(constants or {})
    check_strategies(df, strategies, order_by)

    first = {"rows": F.count("*")}
    counted = [c for c, s in strategies.items() if s in (Strategy.MEDIAN, Strategy.MODE)]
    for i, (c, s) in enumerate(strategies.items()):
        first[f"n_{i}"] = F.count(known(df, c))
        if s is Strategy.MEAN:
            first[f"mean_{i}"] = F.avg(known(df, c))
        if c in counted:
            first[f"d_{i}"] = F.approx_count_distinct(known(df, c))
    got = one_row(df, first)
    rows = got["rows"]
    at = {c: i for i, c in enumerate(strategies)}
    gaps = {c: rows - got[f"n_{at[c]}"] for c in strategies}
    sizes = {c: (got[f"n_{at[c]}"], got[f"d_{at[c]}"]) for c in counted}
    live = [c for c in strategies if 0 < gaps[c] < rows]
    medians, modes = stats.quantiles_and_modes(
        df,
        {c: [0.5] for c in live if strategies[c] is Strategy.MEDIAN},
        [c for c in live if strategies[c] is Strategy.MODE],
        approx,
        distinct_limit,
        sizes,
    )

    fills = []
    for c, s in strategies.items():
        kind = family(df.schema[c].dataType)
        if not gaps[c]:
            continue
        value, success, error = None, True, ""
        if s is Strategy.CONSTANT:
            value = constants.get(c, CONSTANTS[kind])
        elif s is Strategy.MODE and kind == "text" and gaps[c] == rows:
            value = constants.get(c, V.UNKNOWN_TEXT)
        elif s not in (Strategy.DROP, Strategy.SKIP) and gaps[c] == rows:
            success, error = False, "column has no value to fill from"
        elif s is Strategy.MEAN:
            value = got[f"mean_{at[c]}"]
        elif s is Strategy.MEDIAN:
            value = medians[c][0]
        elif s is Strategy.MODE:
            value = modes[c]
        fills.append(ColumnFill(c, s, gaps[c], value, success, error))
    return FittedFill(rows, tuple(fills), tuple(order_by), tuple(partition_by), rows_per_bucket)


def fill_numeric(df: DataFrame, columns=None, strategy=Strategy.MEDIAN, **options) -> DataFrame:
    """Fill numeric columns, all by one strategy (M1)."""
    names = columns_of(df, "numeric") if columns is None else columns
    return fit(df, {c: strategy for c in names}, **options).transform(df)


def fill_text(df: DataFrame, columns=None, strategy=Strategy.MODE, constant=V.UNKNOWN_TEXT, **options) -> DataFrame:
    """Fill text columns by mode, constant or along an order (M2)."""
    names = columns_of(df, "text") if columns is None else columns
    return fit(df, {c: strategy for c in names}, {c: constant for c in names}, **options).transform(df)


def fill_boolean(df: DataFrame, columns=None, default: bool = False) -> DataFrame:
    """Fill boolean and boolean-like columns by a constant (M3).

    By default boolean and text columns are looked at: a number column that
    holds 0 and 1 may be a quantity, so it must be named.  In a boolean-like text column "false" is written the way the column writes
    its own negative value.
    """
    likes = boolean_like(df, columns_of(df, "text", "boolean") if columns is None else columns)
    fills = {}
    for c in likes:
        if isinstance(df.schema[c].dataType, T.BooleanType):
            fills[c] = F.coalesce(col(c), F.lit(default))
        else:
            text = likes[c] if not default else _positive(likes[c])
            fills[c] = F.coalesce(known(df, c), F.lit(text).cast(df.schema[c].dataType))
    return df.withColumns(fills) if fills else df


def _positive(negative: str) -> str:
    yes = {no: yes for yes, no in V.BOOLEAN_PAIRS}.get(negative.upper(), "TRUE")
    if negative.isupper() or not negative.isalpha():
        return yes
    return yes.lower() if negative.islower() else yes.title()


def fill_datetime(
    df: DataFrame, order_by: Sequence[str], columns=None, strategy=Strategy.FORWARD_FILL, **options
) -> DataFrame:
    """Fill date and time columns along an order (M4).

    Text columns of which every value reads as a date are read as time first; a
    column without missing values stays as it is.  A named text column with
    other values is refused, as filling would lose them.
    """
    names = columns_of(df, "datetime") + datetime_like(df) if columns is None else list(columns)
    gaps = one_row(df, {c: F.count_if(col(c).isNull()) for c in names})
    names = [c for c in names if gaps[c]]
    texts = [c for c in names if family(df.schema[c].dataType) != "datetime"]
    lost = one_row(df, {c: F.count_if(col(c).isNotNull() & to_time(col(c)).isNull()) for c in texts})
    if any(lost.values()):
        raise ValueError(f"texts that are no dates: {({c: n for c, n in lost.items() if n})}")
    df = df.withColumns({c: to_time(col(c)) for c in texts}) if texts else df
    return fit(df, {c: strategy for c in names}, order_by=order_by, **options).transform(df)


def plan_strategies(
    df: DataFrame, custom: Mapping[str, Strategy | str] | None = None, defaults: Mapping[str, Strategy] | None = None
) -> dict[str, Strategy]:
    """Strategy per column: the caller's first, then the default of its type (M5)."""
    by_family = {**DEFAULTS, **(defaults or {})}
    plan = {f.name: by_family[family(f.dataType)] for f in df.schema}
    plan.update({c: Strategy(s) for c, s in (custom or {}).items()})
    return plan


def fit_all(df: DataFrame, custom=None, defaults=None, **options) -> FittedFill:
    """Fit every column of the table (M5)."""
    return fit(df, plan_strategies(df, custom, defaults), **options)


def clean_result(df: DataFrame) -> DataFrame:
    """Make an answer table rectangular: texts to ``N/A``, numbers to 0 (M7)."""
    fills = {}
    for f in df.schema:
        kind = family(f.dataType)
        if kind == "text":
            fills[f.name] = F.coalesce(F.nullif(col(f.name), F.lit("")), F.lit(V.NOT_AVAILABLE_TEXT))
        elif kind == "numeric":
            zero = F.lit(0).cast(f.dataType)
            fills[f.name] = F.coalesce(known(df, f.name), zero)
    return df.withColumns(fills) if fills else df


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to numbers, bad text to 0 (the numeric half of M7)."""
    return df.withColumns({c: F.coalesce(to_number(col(c)), F.lit(0.0)) for c in columns})
