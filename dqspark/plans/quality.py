"""From a cleaned table to flagged data with reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from dqspark.operators import flags, profile, sample
from dqspark.operators.columns import rename, valid_renames
from dqspark.operators.flags import FlagRun
from dqspark.operators.issues import issue_metrics, rename_in_issues
from dqspark.operators.rules import Rule, suggest_rules
from dqspark.sources.readers import read_table
from dqspark.sources.sinks import export_all, write_issues, write_rules, write_table


@dataclass(frozen=True)
class Checked:
    renamed: DataFrame
    issues: DataFrame
    run: FlagRun
    renames: Mapping[str, str]

    def reports(self) -> dict[str, DataFrame]:
        return {
            "execution_summary": self.run.summary(),
            "rule_results": self.run.rule_results(),
            "flag_counts": flags.flag_counts(self.run.data, [r.flag_value for r in self.run.rules]),
            "flag_combinations": flags.flag_combinations(self.run.data),
            "issue_metrics": issue_metrics(self.issues),
        }

    def export(self, path: str, format: str = "parquet") -> dict[str, str]:
        """Flagged data, reports, flag table and rules under one directory.

        The reports read the written data, so the rules are computed once.
        """
        spark = self.run.data.sparkSession
        data = write_table(self.run.data, f"{path}/flagged_data", format)
        schema = self.run.data.schema
        stored = replace(self, run=replace(self.run, data=read_table(spark, data, format, schema)))
        written = export_all(spark, path, {}, stored.reports(), self.renames)
        written["flagged_data"] = data
        written["flag_table"] = write_issues(self.issues, f"{path}/flag_table")
        written["rules"] = write_rules(spark, self.run.rules, f"{path}/rules")
        return written


def look_at(df: DataFrame, keys: Sequence[str], max_rows: int = 150) -> dict[str, DataFrame]:
    """What a reviewer gets to see before rules are chosen: sample and column facts."""
    return {"sample": sample.take_sample(df, keys, max_rows), "column_info": profile.column_info(df)}


def check(
    df: DataFrame, rules: Sequence[Rule] | None = None, renames: Mapping[str, str] | None = None
) -> Checked:
    """Rename, number the rules and flag all rows in one pass.

    Without rules those that names and values call for are taken.  Rules refer
    to the new names; the texts of their issues follow the renaming.
    """
    mapping = valid_renames(renames or {}, df.columns)
    renamed = rename(df, mapping)
    rules = suggest_rules(renamed) if rules is None else rules
    run = flags.flag_rows(renamed, rules)
    issues = rename_in_issues(flags.issues_of_rules(df.sparkSession, run.rules), mapping)
    return Checked(renamed, issues, run, mapping)
