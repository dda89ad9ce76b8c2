"""From loaded tables to one joined, cleaned and filled table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from dqspark.operators.clean import Cleaned, basic_clean
from dqspark.operators.impute import FittedFill, Strategy, fit_all
from dqspark.operators.joins import JoinSpec, join_chain


@dataclass(frozen=True)
class Prepared:
    joined: DataFrame
    cleaned: Cleaned
    fill: FittedFill
    data: DataFrame

    def stages(self) -> dict[str, DataFrame]:
        return {"Original": self.joined, "Phase 1 (Cleaned)": self.data}


def prepare(
    tables: Mapping[str, DataFrame],
    primary_table: str,
    joins: Sequence[JoinSpec] = (),
    strategies: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
    case: str | None = "title",
    store: str | None = None,
    **fill_options,
) -> Prepared:
    """Join, clean and fill.

    The table is read for the prefixes and for the fill statistics before it is
    read for the result.  ``store`` names a shared folder; the joined table
    without duplicates is written there once and read from it afterwards, which
    spares repeating the joins and survives lost executors.  Time columns are filled
    along ``order_by``; without one they are left as they are.
    """
    joined = join_chain(tables, primary_table, joins)
    cleaned = basic_clean(joined, case=case, store=store)
    data = cleaned.data
    defaults = {} if order_by else {"datetime": Strategy.SKIP}
    fill = fit_all(data, strategies, defaults, order_by=order_by, **fill_options)
    return Prepared(joined, cleaned, fill, fill.transform(data))

