"""Flag table, one-pass flagging, and reports on the status column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.flagbits import binary_text, flag_value, flags_text, has_flag, set_flags
from dqspark.operators.columns import col, one_row
from dqspark.operators.rules import Rule, check_rule, fallback, lenient, numbered

STATUS = "flag_status"
ISSUE_SCHEMA = (
    "flag_value bigint, description string, category string, severity string, "
    "affected_columns array<string>, fix_approach string"
)


def reset_status(df: DataFrame, status: str = STATUS) -> DataFrame:
    """Add the status column, or set it back to 0."""
    return df.withColumn(status, F.lit(0).cast("bigint"))


# --- flagging ---------------------------------------------------------------


@dataclass(frozen=True)
class FlagRun:
    """A lazily flagged table and the outcome of the rule checks."""

    data: DataFrame
    rules: tuple[Rule, ...]
    errors: Mapping[int, str]
    status: str = STATUS

    def rule_results(self) -> DataFrame:
        """Rows found per rule, success and error (A18); one aggregate."""
        spark = self.data.sparkSession
        found = one_row(
            self.data, {f"n_{r.flag_value}": F.count_if(has_flag(col(self.status), r.flag_value)) for r in self.rules}
        )
        rows = [
            (r.flag_value, not self.errors.get(r.flag_value), found[f"n_{r.flag_value}"], r.explanation,
             r.detection_code, self.errors.get(r.flag_value) or None)
            for r in self.rules
        ]
        return spark.createDataFrame(
            rows,
            "flag_value bigint, success boolean, rows_detected bigint, explanation string, "
            "detection_code string, error string",
        )

    def summary(self) -> DataFrame:
        """Totals of the run (A17); one aggregate."""
        good = sum(1 for r in self.rules if not self.errors.get(r.flag_value))
        status = col(self.status)
        flagged = F.count_if(status != 0)
        total = F.count("*")
        return self.data.agg(
            total.alias("total_rows"),
            flagged.alias("flagged_rows"),
            (total - flagged).alias("clean_rows"),
            F.round(F.try_divide(flagged * 100.0, total), 2).alias("flagged_percentage"),
            F.coalesce(F.sum(F.bit_count(status).cast("bigint")), F.lit(0)).alias("total_detections"),
            F.lit(good).cast("bigint").alias("successful_codes"),
            F.lit(len(self.rules) - good).cast("bigint").alias("failed_codes"),
            F.round(F.try_divide(F.lit(100.0 * good), F.lit(len(self.rules))), 2).alias("success_rate"),
        )


def flag_rows(df: DataFrame, rules: Sequence[Rule], status: str = STATUS) -> FlagRun:
    """Check the rules, then set all their bits in one projection.

    A rule that cannot be used is replaced by its fallback and reported; the
    others run.  A row whose values a rule cannot be computed on (text against a
    number, a division by zero) is not flagged by it.  NULL conditions do not
    flag.  Without rules every status is 0.
    """
    rules = numbered(rules)
    used, errors = [], {}
    for rule in rules:
        error = check_rule(df, rule)
        errors[rule.flag_value] = error
        if error:
            rule = fallback(rule)
            if check_rule(df, rule):
                continue
        used.append(rule)
    bits = [
        F.when(F.expr(r.detection_code), F.lit(r.flag_value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        for r in used
    ]
    mask = reduce(Column.bitwiseOR, bits, F.lit(0).cast("bigint"))
    with lenient(df.sparkSession):  # values a rule cannot read are no match and stop no other rule
        flagged = df.withColumn(status, mask)
    return FlagRun(flagged, tuple(rules), errors, status)


# --- reports on the status column -------------------------------------------


def flag_counts(df: DataFrame, flags: Sequence[int], status: str = STATUS) -> DataFrame:
    """Rows per flag, all flags in one aggregate."""
    rows = [
        F.struct(F.lit(f).cast("bigint").alias("flag_value"), F.count_if(has_flag(col(status), f)).alias("row_count"))
        for f in flags
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def flag_combinations(df: DataFrame, status: str = STATUS) -> DataFrame:
    """Rows per status value, decoded."""
    # A condition on the status itself would be moved below the grouping and all
    # rules would be computed twice; one on an aggregate stays where it is.
    counted = df.groupBy(col(status).alias("flag_status")).agg(
        F.count("*").alias("row_count"), F.max(col(status)).alias("__status")
    )
    grouped = counted.where(F.col("__status") != 0)
    s = F.col("flag_status")
    return grouped.select(
        s, set_flags(s).alias("individual_flags"), flags_text(s, label="Flags ").alias("flag_description"),
        "row_count", binary_text(s).alias("binary_representation"),
    )


def flagged_sample(df: DataFrame, n: int = 10, order_by: Sequence[str] = (), status: str = STATUS) -> DataFrame:
    """The first n flagged rows with their flags in words (P10)."""
    rows = df.where(col(status) > 0)
    rows = rows.orderBy(*[col(c) for c in order_by]) if order_by else rows
    return rows.limit(n).withColumn("flag_breakdown", flags_text(col(status)))


def decoded(df: DataFrame, issues: DataFrame, keys: Sequence[str], status: str = STATUS) -> DataFrame:
    """One row per row and flag set, with the issue behind the flag.

    The status is taken apart into its flags first, so that issues join by
    equality; a bigint has at most 63 flags, hence at most 63 issues.
    """
    # explode_outer, as explode makes Spark compute the array (and with it all
    # rules) once more in a filter below
    parts = df.select(*[col(k) for k in keys], F.explode_outer(set_flags(col(status))).alias("flag_value"))
    flags = parts.where(F.col("flag_value").isNotNull())
    return flags.join(F.broadcast(_at_most_all_flags(issues)), "flag_value", "left")


def _at_most_all_flags(issues: DataFrame) -> DataFrame:
    """The flag table, refused if it has more rows than a status has bits."""
    n = issues.count()
    if n > V.MAX_FLAGS:
        raise ValueError(f"a status holds at most {V.MAX_FLAGS} flags; the flag table has {n} rows")
    return issues


# --- the flag table ---------------------------------------------------------


def issue_table(spark: SparkSession, issues: Sequence[Mapping]) -> DataFrame:
    """Flags 1, 2, 4, ... for issues in their order, with defaults (F16)."""
    fields = ISSUE_SCHEMA.replace("flag_value bigint, ", "")
    given = spark.createDataFrame([(i, flag_value(i), dict(issue)) for i, issue in enumerate(issues)], f"i int, flag_value bigint, given struct<{fields}>")
    return given.orderBy("i").select("flag_value", *issue_fields(F.concat(F.lit("Issue "), (F.col("i") + 1).cast("string")), F.lit(V.DEFAULT_FIX), "given."))


def issue_fields(description: Column, fix_approach: Column, prefix: str = "") -> list[Column]:
    """The fields of an issue with defaults for those that are absent."""
    return [
        F.coalesce(prefix + "description", description).alias("description"),
        F.coalesce(prefix + "category", F.lit(V.UNKNOWN_CATEGORY)).alias("category"),
        F.coalesce(prefix + "severity", F.lit(V.DEFAULT_SEVERITY)).alias("severity"),
        F.coalesce(prefix + "affected_columns", F.array().cast("array<string>")).alias("affected_columns"),
        F.coalesce(prefix + "fix_approach", fix_approach).alias("fix_approach"),
    ]


def issues_of_rules(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The flag table of a rule set."""
    rows = [
        (r.flag_value, r.explanation, r.category, r.severity, list(r.columns), V.DEFAULT_FIX) for r in numbered(rules)
    ]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def flag_table_summary(issues: DataFrame) -> DataFrame:
    """Number of flags, largest and combined value, possible combinations."""
    n = F.count("*")
    return issues.agg(
        n.alias("total_flags"),
        F.max("flag_value").alias("max_flag_value"),
        F.sum("flag_value").alias("max_combined_value"),
        (F.pow(F.lit(2.0), n) - 1).cast("decimal(20,0)").alias("possible_combinations"),
        F.array_sort(F.collect_list("flag_value")).alias("flag_values"),
    )


def flag_distribution(issues: DataFrame) -> DataFrame:
    """Flags by severity and by category."""
    parts = [
        issues.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("n_flags")).withColumn("kind", F.lit(kind))
        for kind in ("severity", "category")
    ]
    return parts[0].unionByName(parts[1]).select("kind", "name", "n_flags")


def possible_combinations(issues: DataFrame, most: int | None = V.MAX_LISTED_COMBINATIONS) -> DataFrame:
    """Status values 1, 2, 3, ... with the issues they stand for.

    Values below ``most`` are listed, all if it is None; ``in_all`` is their full
    number and ``listed_in_full`` tells whether the list is complete.
    """
    flags = _at_most_all_flags(issues).select("flag_value", "description")
    n = flags.count()
    top = 2**n if most is None else min(2**n, most)
    if top >= 2**63:
        raise ValueError("so many combinations cannot be listed; give most")
    values = issues.sparkSession.range(1, top).select(F.col("id").alias("combined"))
    parts = values.select("combined", F.explode(set_flags(F.col("combined"))).alias("flag_value"))
    named = parts.join(F.broadcast(flags), "flag_value")  # at most 63 rows
    listed = F.array_sort(F.collect_list(F.struct("flag_value", "description")))
    return named.groupBy("combined").agg(listed.alias("l")).select(
        "combined", F.col("l.description").alias("issues"), F.lit(2**n - 1).cast("decimal(20,0)").alias("in_all"),
        F.lit(top == 2**n).alias("listed_in_full"),
    )


def with_binary(issues: DataFrame) -> DataFrame:
    """Flag table with eight-digit binary values."""
    return issues.withColumn("binary_representation", binary_text(F.col("flag_value"), 8))
