"""All registered queries of this package."""

from __future__ import annotations

from dqspark.llm import queries_encodings, queries_models, queries_rows, queries_texts  # noqa: F401
from dqspark.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
