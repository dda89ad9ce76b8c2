"""Statuses of several words, for more rules than a bigint has bits.

Flag p is bit ``p % 63`` of word ``p // 63``, so a first word alone is the usual
bigint status.  Flags are named by their position and by 2^p as a decimal text,
which no number type of Spark would hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.flagbits import has_flag
from dqspark.operators.columns import col
from dqspark.operators.flags import flag_rows
from dqspark.operators.rules import Rule

STATUS = "flag_words"
FLAG_SCHEMA = (
    "position int, flag_value string, description string, category string, severity string, "
    "affected_columns array<string>, fix_approach string"
)


def n_words(n_flags: int) -> int:
    return max(1, -(-n_flags // V.MAX_FLAGS))


def flag_name(position: int) -> str:
    """2^p in digits (F16)."""
    if position < 0:
        raise ValueError("positions begin at 0")
    return str(1 << position)


def is_flagged(words: Column) -> Column:
    return F.exists(words, lambda w: w != 0)


def has_position(words: Column, position: int) -> Column:
    return has_flag(F.get(words, F.lit(position // V.MAX_FLAGS)), 1 << (position % V.MAX_FLAGS))


def count_flags(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def positions(words: Column) -> Column:
    """The flags that are set, ascending."""
    bits = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(1 << i).cast("bigint").alias("bit")) for i in range(V.MAX_FLAGS)])

    def of_word(word: Column, i: Column) -> Column:
        found = F.filter(bits, lambda b: word.bitwiseAND(b["bit"]) != 0)
        return F.transform(found, lambda b: i * V.MAX_FLAGS + b["at"])

    return F.flatten(F.transform(words, of_word))


def flags_text(words: Column, n_flags: int, label: str = "Flags: ", none: str = "No flags") -> Column:
    """``Flags: 1+4`` or ``No flags``, whatever the size of the numbers."""
    names = F.array(*[F.lit(flag_name(p)) for p in range(n_flags)])
    listed = F.transform(positions(words), lambda p: F.element_at(names, p + 1))
    return F.when(is_flagged(words), F.concat(F.lit(label), F.array_join(listed, "+"))).otherwise(F.lit(none))


def binary_text(words: Column) -> Column:
    """Binary digits of the whole status, the highest word first."""
    digits = F.array_join(F.transform(F.reverse(words), lambda w: F.lpad(F.bin(w), V.MAX_FLAGS, "0")), "")
    short = F.ltrim(digits, F.lit("0"))
    return F.when(short == "", F.lit("0")).otherwise(short)


def merged(words: str | Column, n_flags: int) -> Column:
    """Aggregate: the flags any row of a group has."""
    words = col(words) if isinstance(words, str) else words
    return F.array(*[F.coalesce(F.bit_or(F.get(words, F.lit(i))), F.lit(0).cast("bigint")) for i in range(n_words(n_flags))])


@dataclass(frozen=True)
class WideRun:
    """A lazily flagged table; rules and errors by position."""

    data: DataFrame
    rules: tuple[Rule, ...]
    errors: Mapping[int, str]
    status: str = STATUS

    def rule_results(self) -> DataFrame:
        """Rows found per rule, success and error; one aggregate."""
        words = col(self.status)
        counts = F.array(*[F.count_if(has_position(words, p)) for p in range(len(self.rules))])
        found = self.data.agg(counts.alias("n")).select(F.posexplode("n").alias("position", "rows_detected"))
        listed = [
            (p, flag_name(p), not self.errors.get(p), r.explanation, r.detection_code, self.errors.get(p) or None)
            for p, r in enumerate(self.rules)
        ]
        table = self.data.sparkSession.createDataFrame(
            listed, "position int, flag_value string, success boolean, explanation string, detection_code string, error string"
        )
        return table.join(found, "position")

    def issues(self) -> DataFrame:
        """The flag table of the rules."""
        return wide_issues(self.data.sparkSession, self.rules)


def wide_issues(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (p, flag_name(p), r.explanation, r.category, r.severity, list(r.columns), V.DEFAULT_FIX) for p, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, FLAG_SCHEMA)


def flag_rows_wide(df: DataFrame, rules: Sequence[Rule], status: str = STATUS) -> WideRun:
    """Check any number of rules and set their bits in one projection.

    Rules take positions in their order; flags they bring along are not kept, as
    they are those of a single word.  Unusable rules are replaced and reported as
    with one word.
    """
    rules = tuple(replace(r, flag_value=0) for r in rules)
    data, errors, words = df, {}, []
    for start in range(0, max(1, len(rules)), V.MAX_FLAGS):
        name = f"__word_{len(words)}"
        run = flag_rows(data, rules[start : start + V.MAX_FLAGS], name)
        data = run.data
        words.append(name)
        errors |= {start + flag.bit_length() - 1: text for flag, text in run.errors.items() if text}
    data = data.withColumn(status, F.array(*[F.col(w) for w in words])).drop(*words)
    return WideRun(data, rules, errors, status)


def flag_combinations(df: DataFrame, n_flags: int, status: str = STATUS) -> DataFrame:
    """Rows per status, decoded (A16); rows without flags are left out."""
    words = F.col("__words")
    counted = df.groupBy(col(status).alias("__words")).agg(F.count("*").alias("row_count"), F.max(is_flagged(col(status))).alias("__any"))
    return counted.where("__any").select(
        words.alias(status), positions(words).alias("positions"), flags_text(words, n_flags, "Flags ").alias("flag_description"),
        "row_count", binary_text(words).alias("binary_representation"),
    )


def decoded(df: DataFrame, issues: DataFrame, keys: Sequence[str], status: str = STATUS) -> DataFrame:
    """One row per row and flag set, with the issue behind the flag (F17); the flag table has a row per rule."""
    parts = df.select(*[col(k) for k in keys], F.explode_outer(positions(col(status))).alias("position"))
    return parts.where(F.col("position").isNotNull()).join(issues, "position", "left")
