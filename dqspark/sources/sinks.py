"""Sinks (S4-S6, S8, S11).  Every table is written in parallel by its tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators.columns import renaming_report
from dqspark.operators.flags import flag_table_summary, with_binary
from dqspark.operators.rules import Rule, numbered
from dqspark.sources.readers import RULE_SCHEMA


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> str:
    """Renamed, flagged or final data (S4); CSV gets a header."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
    return path


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A report as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The flag table with its metadata.

    ``flags`` holds the full records with binary values, ``flag_mapping`` the
    short form (flag, description), ``metadata`` one row of totals.
    """
    write_report(with_binary(issues), f"{path}/flags", mode)
    write_report(issues.select("flag_value", "description"), f"{path}/flag_mapping", mode)
    totals = flag_table_summary(issues).withColumn("created_at", F.current_timestamp())
    write_report(totals, f"{path}/metadata", mode)
    return path


def write_rules(spark: SparkSession, rules: Sequence[Rule], path: str, mode: str = "overwrite") -> str:
    """Detection rules as JSON."""
    rows = [
        (r.flag_value, r.detection_code, list(r.columns), r.explanation, r.category, r.severity,
         r.test_description, r.safety_notes)
        for r in numbered(rules)
    ]
    return write_report(spark.createDataFrame(rows, RULE_SCHEMA), path, mode)


def export_all(
    spark: SparkSession,
    path: str,
    tables: Mapping[str, DataFrame],
    reports: Mapping[str, DataFrame] | None = None,
    renamings: Mapping[str, str] | None = None,
    format: str = "parquet",
) -> dict[str, str]:
    """Every stage's table and report under one directory."""
    written = {name: write_table(df, f"{path}/{name}", format) for name, df in tables.items()}
    written |= {name: write_report(df, f"{path}/{name}") for name, df in (reports or {}).items()}
    if renamings is not None:
        written["renaming_report"] = write_report(renaming_report(spark, renamings), f"{path}/renaming_report")
    return written
