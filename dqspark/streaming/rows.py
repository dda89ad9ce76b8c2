"""The row-wise operators on a stream, with statistics fitted on a batch.

Nothing here keeps state: missing texts, white space, case, fitted prefixes,
fitted fills and detection rules look at one row at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dqspark.operators.clean import Prefix, clean_text, set_case, strip_prefixes
from dqspark.operators.flags import flag_rows
from dqspark.operators.impute import ORDERED, FittedFill
from dqspark.operators.rules import Rule
from dqspark.session import checkpoint_dir
from dqspark.sources.readers import normalise_missing


def clean_stream(
    stream: DataFrame,
    prefixes: Sequence[Prefix] = (),
    case: str | None = None,
    fill: FittedFill | None = None,
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """Clean, fill and flag the rows of a stream as the batch steps would."""
    if fill is not None and any(f.strategy in ORDERED for f in fill.fills):
        raise ValueError("a fill along an order needs the whole table; fit statistics for a stream")
    rows = clean_text(normalise_missing(stream))
    rows = strip_prefixes(rows, prefixes)
    rows = set_case(rows, case) if case else rows
    rows = fill.transform(rows) if fill is not None else rows
    return rows if rules is None else flag_rows(rows, rules).data


def write_stream(rows: DataFrame, path: str, name: str, format: str = "parquet") -> StreamingQuery:
    """Write what is there now and stop; progress is kept in the shared folder."""
    return (
        rows.writeStream.format(format)
        .outputMode("append")
        .option("checkpointLocation", f"{checkpoint_dir(rows.sparkSession)}/{name}")
        .trigger(availableNow=True)
        .start(path)
    )
