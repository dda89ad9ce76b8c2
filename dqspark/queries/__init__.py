"""Registered queries with the SQL that gives the same result.

Every query reads whole tables of a directory of Parquet files.  The SQL is in
the dialect of the engine the results are compared with.
"""

from __future__ import annotations

from dqspark.queries import (  # noqa: F401
    answers,
    cleaning,
    fills,
    flagging,
    joining,
    profiling,
    ruling,
    sampling,
    storing,
    texts,
)
from dqspark.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
