"""From a question and a flagged table to a clean answer table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from dqspark.operators.analyze import AnalysisSpec, answer, month_bucket_of, order_of
from dqspark.operators.impute import clean_result


def ask(df: DataFrame, spec: AnalysisSpec, question: str = "") -> DataFrame:
    """Answer a declared question; the wording may set order and month bucket."""
    if question:
        if spec.order is None:
            spec = replace(spec, order=order_of(question))
        if spec.time_bucket == "month":
            spec = replace(spec, time_bucket=month_bucket_of(question))
    return clean_result(answer(df, spec))
