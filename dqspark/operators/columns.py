"""Projection helpers: type families, renaming, missing counts, value kinds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.functions.coerce import nan_to_null, to_time


def quote(name: str) -> str:
    """Column name as SQL identifier; also safe for names with dots."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def family(data_type: T.DataType) -> str:
    """``numeric``, ``text``, ``boolean``, ``datetime`` or ``other``."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema if family(f.dataType) in families]


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    return nan_to_null(col(name), df.schema[name].dataType)


def missing_count(df: DataFrame, names: Iterable[str] | None = None) -> Column:
    """Number of missing cells in a row."""
    names = list(df.columns if names is None else names)
    return reduce(add, [known(df, c).isNull().cast("int") for c in names], F.lit(0))


def one_row(df: DataFrame, columns: Mapping[str, Column]) -> dict:
    """Run one global aggregate and give its single row as a dict."""
    if not columns:
        return {}
    return df.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def with_nan_as_null(df: DataFrame) -> DataFrame:
    fractions = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: known(df, c) for c in fractions}) if fractions else df


# --- renaming ---------------------------------------------------------------


def valid_renames(suggested: Mapping[str, str], columns: Iterable[str] | None = None) -> dict[str, str]:
    """Keep the suggestions that are real new names, trimmed."""
    names = set(suggested) if columns is None else set(columns)
    kept = {}
    for old, new in suggested.items():
        new = (new or "").strip()
        if old in names and new and new != old and not new.startswith(V.NO_NAME_PREFIX):
            kept[old] = new
    return kept


def full_renames(suggested: Mapping[str, str], columns: Iterable[str]) -> dict[str, str]:
    """A map that covers every column; the others keep their name."""
    return {c: suggested.get(c) or c for c in columns}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; two columns may not end under one name."""
    mapping = {old: new for old, new in mapping.items() if old in df.columns}
    after = [mapping.get(c, c) for c in df.columns]
    twice = sorted({c for c in after if after.count(c) > 1})
    if twice:
        raise ValueError(f"renaming gives these names more than once: {twice}")
    return df.withColumnsRenamed(mapping) if mapping else df


def friendly_names(columns: Iterable[str]) -> dict[str, str]:
    """Names without the table prefix all columns share, in snake case (P5)."""
    columns = list(columns)
    heads = {c.split("_", 1)[0] for c in columns if "_" in c[1:]}
    shared = len(columns) > 1 and len(heads) == 1 and all("_" in c[1:] for c in columns)

    def one(name: str) -> str:
        rest = name.split("_", 1)[1] if shared else name
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", rest)
        return re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower() or name

    return {c: one(c) for c in columns}


# --- kinds of values --------------------------------------------------------


def boolean_like(df: DataFrame, names: Iterable[str] | None = None) -> dict[str, str]:
    """Boolean-like columns with the text that stands for "no" (P8, U3).

    A column is boolean-like when its distinct upper-cased values are a subset
    or a superset of one of the known pairs.  The test needs no value set: per
    pair, one aggregate tells whether each member occurs and whether anything
    else does.  A column without any value is not boolean-like.
    """
    names = columns_of(df, "text", "numeric", "boolean") if names is None else list(names)
    aggregates = {}
    for i, name in enumerate(names):
        up = F.upper(known(df, name).cast("string"))
        aggregates[f"some_{i}"] = F.count(up)
        for j, (yes, no) in enumerate(V.BOOLEAN_PAIRS):
            aggregates[f"yes_{i}_{j}"] = F.count_if(up == yes)
            aggregates[f"no_{i}_{j}"] = F.count_if(up == no)
            # the pair's negative value as it is written in this column
            aggregates[f"text_{i}_{j}"] = F.min(F.when(up == no, known(df, name).cast("string")))
    got = one_row(df, aggregates)
    found = {}
    for i, name in enumerate(names):
        for j, (_, no) in enumerate(V.BOOLEAN_PAIRS):
            yes_n, no_n = got[f"yes_{i}_{j}"], got[f"no_{i}_{j}"]
            subset = got[f"some_{i}"] > 0 and yes_n + no_n == got[f"some_{i}"]
            superset = yes_n > 0 and no_n > 0
            if subset or superset:
                found[name] = got[f"text_{i}_{j}"] or no
                break
    return found


def datetime_like(df: DataFrame, names: Iterable[str] | None = None, unreadable_share: float = 0.0) -> list[str]:
    """Text columns whose values read as dates (P9): all of them, or all but a share.

    Every row is looked at, in one aggregate for all columns.
    """
    names = columns_of(df, "text") if names is None else list(names)
    counts = {}
    for i, c in enumerate(names):
        counts[f"n_{i}"] = F.count(col(c))
        counts[f"bad_{i}"] = F.count_if(col(c).isNotNull() & to_time(col(c)).isNull())
    got = one_row(df, counts)
    return [c for i, c in enumerate(names) if got[f"n_{i}"] and got[f"bad_{i}"] <= unreadable_share * got[f"n_{i}"]]


def value_kinds(df: DataFrame) -> DataFrame:
    """One row per column: type family, boolean-like, datetime-like."""
    booleans = boolean_like(df)
    dates = set(datetime_like(df))
    rows = [
        (f.name, f.dataType.simpleString(), family(f.dataType), f.name in booleans, f.name in dates)
        for f in df.schema
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, family string, boolean_like boolean, datetime_like boolean"
    )


# --- small tables -----------------------------------------------------------


def schema_summary(df: DataFrame) -> DataFrame:
    """Columns with types, their number and the row count."""
    listed = ", ".join(f"{n}({t})" for n, t in df.dtypes)
    return df.agg(
        F.lit(listed).alias("columns"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.count("*").alias("n_rows"),
    )


def map_to_rows(df: DataFrame, map_column: str, key: str = "Key", value: str = "Value") -> DataFrame:
    """A map column as a two-column table."""
    return df.select(F.explode(col(map_column)).alias(key, value))


def renaming_report(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """Applied renamings with a time stamp and their number."""
    rows = [(old, new) for old, new in mapping.items()]
    report = spark.createDataFrame(rows, "old_name string, new_name string")
    return report.withColumns(
        {"applied_at": F.current_timestamp(), "total_renamed": F.lit(len(rows)).cast("bigint")}
    )
