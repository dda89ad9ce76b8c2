"""Conversions that give NULL instead of an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.functions.text import trim_space


NUMBER_SUFFIX = r"[0-9.][dDfF]\s*$"


def to_number(c: Column) -> Column:
    """Text or number to double, bad text to NULL.

    A cast would read the suffix of ``5d`` or ``5f`` as a type; that text is bad
    here.  ``typeof`` is a constant, so the test vanishes for other types.
    """
    suffixed = (F.typeof(c) == "string") & c.cast("string").rlike(NUMBER_SUFFIX)
    return F.when(suffixed, F.lit(None)).otherwise(c.try_cast("double"))


def to_time(c: Column) -> Column:
    """Text, date or timestamp to timestamp without zone, bad text to NULL."""
    return c.try_cast("timestamp_ntz")


def to_flag(c: Column, true_texts: Iterable[str] = V.TRUE_TEXTS) -> Column:
    """True where the trimmed lower-cased text is one of the true texts."""
    return F.coalesce(F.lower(trim_space(c.cast("string"))).isin(*true_texts), F.lit(False))


def nan_to_null(c: Column, data_type: T.DataType) -> Column:
    """NaN is one more way to be missing."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c
