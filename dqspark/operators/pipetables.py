"""Tables written with ``|`` inside a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions.text import trim_space
from dqspark.operators.columns import col


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of the pipe table in each text: (key, row_no, col_no, cell).

    Lines with ``|`` form the table, at least two of them; separator lines with
    ``---`` are dropped.  Row 0 is the header.  A column without any non-blank
    cell below the header is dropped.  All of it happens inside the row: there
    is no shuffle.
    """
    lines = F.filter(F.split(col(text), r"\r\n|\r|\n"), lambda line: F.contains(line, F.lit("|")))
    cells = F.transform(
        F.filter(F.col("lines"), lambda line: ~F.contains(line, F.lit("---"))),
        lambda line: F.transform(F.split(trim_space(line), r"\|"), trim_space),
    )
    # numbers of the columns with a non-blank cell below the header
    below = F.flatten(
        F.transform(
            F.slice("rows", F.lit(2), F.size("rows")),
            lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", i + 1)), lambda i: i.isNotNull()),
        )
    )
    filled = F.array_distinct(below)
    # Each step is exploded from an array of one, as a filter on a projected
    # expression would be computed once more below the projection.
    with_lines = df.where(F.contains(col(text), F.lit("|"))).select(col(key), F.explode(F.array(lines)).alias("lines"))
    with_rows = with_lines.where(F.size("lines") >= 2).select(col(key), F.explode(F.array(cells)).alias("rows"))
    tables = with_rows.select(col(key), "rows", F.explode(F.array(filled)).alias("filled"))
    rows = tables.select(col(key), "filled", F.posexplode("rows").alias("row_no", "row"))
    cols = rows.select(col(key), "row_no", "row", F.explode("filled").alias("c"))
    return cols.where(F.col("c") <= F.size("row")).select(
        col(key), "row_no", (F.col("c") - 1).alias("col_no"), F.element_at("row", F.col("c")).alias("cell")
    )
