"""Registered queries of the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqspark.llm import quality, toxicity
from dqspark.llm.common import read
from dqspark.llm.registry import query


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether its language keeps it."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
