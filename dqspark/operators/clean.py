"""Duplicates, white space, letter case and column-wide prefixes."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import text
from dqspark.operators import stats
from dqspark.operators.columns import col, columns_of, one_row

LEADING_LETTERS = r"^([A-Za-z]+)"
UNDERSCORE_TOKEN = r"^([A-Za-z]+)_"
SEPARATOR = r"^[\s:_\-]+"

REPORT_SCHEMA = "operation string, column string, detail string, pct_rows double, success boolean"


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each whole row."""
    return df.dropDuplicates()


def clean_text(df: DataFrame, columns: Sequence[str] | None = None, blank_as_null: bool = True) -> DataFrame:
    """Trim text columns and collapse white space (F1)."""
    names = columns_of(df, "text") if columns is None else columns
    cleaned = {c: text.clean_space(col(c)) for c in names}
    if blank_as_null:
        cleaned = {c: F.nullif(e, F.lit("")) for c, e in cleaned.items()}
    return df.withColumns(cleaned) if cleaned else df


def set_case(df: DataFrame, case: str = "title", columns: Sequence[str] | None = None) -> DataFrame:
    """Give text columns one letter case."""
    names = columns_of(df, "text") if columns is None else columns
    return df.withColumns({c: text.set_case(col(c), case) for c in names}) if names else df


# --- column-wide prefixes ---------------------------------------------------


@dataclass(frozen=True)
class Prefix:
    """A prefix found in a column; ``exact`` prefixes are matched in their case."""

    column: str
    prefix: str
    pct_rows: float
    exact: bool

    def strip(self, strip_separator: bool = False) -> Column:
        s = text.trim_space(col(self.column))
        head = F.substring(s, 1, len(self.prefix))
        starts = (head if self.exact else F.lower(head)) == self.prefix
        rest = F.substr(s, F.lit(len(self.prefix) + 1))
        if strip_separator:
            rest = F.regexp_replace(rest, SEPARATOR, "")
        return F.when(starts, rest).otherwise(s)


def common_prefix(a: str | None, b: str | None) -> str:
    """Longest common prefix of the smallest and largest token of a column."""
    return os.path.commonprefix([a or "", b or ""])


def _text_view(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Trimmed text and its leading tokens, under short names."""
    cols = []
    for i, name in enumerate(names):
        s = text.trim_space(col(name))
        cols += [
            s.alias(f"s_{i}"),
            text.extract_or_null(s, UNDERSCORE_TOKEN).alias(f"token_{i}"),
            F.lower(text.extract_or_null(s, LEADING_LETTERS)).alias(f"letters_{i}"),
        ]
    return df.select(*cols)


def find_prefixes(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.85,
    min_length: int = 3,
    max_length: int = 12,
) -> list[Prefix]:
    """Find ``Token_`` or glued prefixes that nearly all rows share.

    Two aggregates over all text columns: the first names a candidate token and
    the smallest and largest run of leading letters, the second counts.
    """
    names = columns_of(df, "text") if columns is None else list(columns)
    if not names:
        return []
    view = _text_view(df, names)
    places = range(len(names))
    first = {}
    for i in places:
        first |= {f"low_{i}": F.min(f"letters_{i}"), f"high_{i}": F.max(f"letters_{i}")}
        if threshold > 0.5:
            # A token on more than half of the rows is in any sketch of frequent
            # items, so the sketch names it and the next aggregate counts it.
            # Two entries, as missing tokens are an item of the sketch as well.
            first[f"top_{i}"] = F.call_function("approx_top_k", F.col(f"token_{i}"), F.lit(2))
    got = one_row(view, first)
    if threshold > 0.5:
        items = {i: [e["item"] for e in got[f"top_{i}"] or [] if e["item"] is not None] for i in places}
        tokens = {i: items[i][0] if items[i] else None for i in places}
    else:
        exact = stats.modes(view, [f"token_{i}" for i in places])
        tokens = {i: exact[f"token_{i}"] for i in places}
    glued = {i: common_prefix(got[f"low_{i}"], got[f"high_{i}"])[:max_length] for i in places}

    counts = {"n": F.count("*")}
    for i in places:
        s = F.col(f"s_{i}")
        if tokens[i] is not None:
            counts[f"token_{i}"] = F.count_if(F.startswith(s, F.lit(tokens[i] + "_")))
        if len(glued[i]) >= min_length:
            starts = F.lower(F.substring(s, 1, len(glued[i]))) == glued[i]
            counts[f"starts_{i}"] = F.count_if(starts)
            counts[f"rest_{i}"] = F.count_if(starts & (F.char_length(s) > len(glued[i])))
    seen = one_row(view, counts)
    found = []
    for i, name in enumerate(names):
        share = _share(seen.get(f"token_{i}", 0), seen["n"])
        if tokens[i] is not None and len(tokens[i]) >= min_length and share >= threshold:
            found.append(Prefix(name, tokens[i] + "_", round(100 * share, 2), True))
            continue
        starts = seen.get(f"starts_{i}", 0)
        share = _share(starts, seen["n"])
        if starts and share >= threshold and seen[f"rest_{i}"] >= 0.9 * starts:
            found.append(Prefix(name, glued[i], round(100 * share, 2), False))
    return found


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def find_token_prefixes(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95
) -> list[Prefix]:
    """Older rule: if nearly all rows have some ``Token_``, the most common one."""
    names = columns_of(df, "text") if columns is None else list(columns)
    if not names:
        return []
    view = _text_view(df, names)
    seen = one_row(view, {"n": F.count("*"), **{f"t_{i}": F.count(f"token_{i}") for i in range(len(names))}})
    fit = [i for i in range(len(names)) if seen["n"] and seen[f"t_{i}"] / seen["n"] >= threshold]
    tokens = stats.modes(view, [f"token_{i}" for i in fit])
    return [
        Prefix(names[i], tokens[f"token_{i}"] + "_", round(100 * seen[f"t_{i}"] / seen["n"], 2), True) for i in fit
    ]


def find_letter_prefixes(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.95,
    min_length: int = 3,
    max_length: int = 10,
) -> list[Prefix]:
    """Older rule for glued prefixes; the remainder is asked of all rows."""
    names = columns_of(df, "text") if columns is None else list(columns)
    if not names:
        return []
    view = _text_view(df, names)
    first = {"n": F.count("*")}
    for i in range(len(names)):
        first |= {f"some_{i}": F.count(f"letters_{i}"), f"low_{i}": F.min(f"letters_{i}"),
                  f"high_{i}": F.max(f"letters_{i}")}
    got = one_row(view, first)
    candidates = {}
    for i in range(len(names)):
        prefix = common_prefix(got[f"low_{i}"], got[f"high_{i}"])[:max_length]
        if _share(got[f"some_{i}"], got["n"]) >= threshold and len(prefix) >= min_length:
            candidates[i] = prefix
    counts = {}
    for i, prefix in candidates.items():
        s = F.col(f"s_{i}")
        counts[f"starts_{i}"] = F.count_if(F.lower(F.substring(s, 1, len(prefix))) == prefix)
        counts[f"rest_{i}"] = F.count_if(F.char_length(s) > len(prefix))
    seen = one_row(view, counts)
    found = []
    for i, prefix in candidates.items():
        share = _share(seen[f"starts_{i}"], got["n"])
        if share >= threshold and _share(seen[f"rest_{i}"], got["n"]) >= 0.9:
            found.append(Prefix(names[i], prefix, round(100 * share, 2), False))
    return found


def strip_prefixes(df: DataFrame, prefixes: Sequence[Prefix], strip_separator: bool = False) -> DataFrame:
    """Cut the found prefixes off; rows without the prefix keep their trimmed text."""
    return df.withColumns({p.column: p.strip(strip_separator) for p in prefixes}) if prefixes else df


# --- the chain --------------------------------------------------------------


@dataclass(frozen=True)
class Cleaned:
    """Result of :func:`basic_clean`: the lazy table and what was done."""

    data: DataFrame
    source: DataFrame
    prefixes: tuple[Prefix, ...]
    duplicates: bool
    text_columns: tuple[str, ...]
    clean_text: bool
    case: str

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per operation and column (A24).  Counts duplicates when asked."""
        rows = []
        if self.duplicates:
            removed = self.source.count() - self.source.dropDuplicates().count()
            rows.append(("remove_duplicates", None, f"Removed {removed} duplicate rows", None, True))
        if self.clean_text and self.text_columns:
            rows.append(("clean_text", None, f"Cleaned text in {len(self.text_columns)} columns", None, True))
        rows += [("strip_uniform_prefixes", p.column, p.prefix, p.pct_rows, True) for p in self.prefixes]
        if self.case != "none" and self.text_columns:
            what = f"Standardized case in {len(self.text_columns)} columns to {self.case}"
            rows.append(("standardize_case", None, what, None, True))
        return spark.createDataFrame(rows, REPORT_SCHEMA)


def basic_clean(
    df: DataFrame,
    remove_duplicates: bool = True,
    clean: bool = True,
    case: str | None = "title",
    prefix_threshold: float = 0.85,
    blank_as_null: bool = True,
    store: str | None = None,
) -> Cleaned:
    """Duplicates, then white space, prefixes and case (F9); each can be left out.

    Prefixes are looked for in the cleaned table, which reads it twice before
    the result does.  ``store`` names a shared folder: the table without
    duplicates is written there once and read from it afterwards, and the search
    then reads only the text columns.
    """
    case = (case or "none").lower()
    text_columns = tuple(columns_of(df, "text"))
    data = drop_duplicates(df) if remove_duplicates else df
    data = clean_text(data, blank_as_null=blank_as_null) if clean else data
    if store:
        data.write.mode("overwrite").parquet(store)
        data = data.sparkSession.read.parquet(store)
    prefixes = find_prefixes(data, threshold=prefix_threshold)
    data = strip_prefixes(data, prefixes)
    if case != "none":
        data = set_case(data, case)
    return Cleaned(data, df, tuple(prefixes), remove_duplicates, text_columns, clean, case)
