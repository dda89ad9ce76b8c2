"""Sources (S1-S3, S7-S10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import values as V
from dqspark.functions.coerce import NUMBER_SUFFIX
from dqspark.functions.text import na_to_null
from dqspark.operators.columns import col, columns_of, one_row, quote, with_nan_as_null
from dqspark.operators.flags import ISSUE_SCHEMA, issue_fields, reset_status
from dqspark.operators.rules import Rule

RULE_SCHEMA = (
    "flag_value bigint, detection_code string, columns array<string>, explanation string, category string, "
    "severity string, test_description string, safety_notes string"
)


def normalise_missing(df: DataFrame, tokens: Sequence[str] = V.NA_TOKENS) -> DataFrame:
    """Missing-value texts and NaN become NULL."""
    texts = columns_of(df, "text")
    df = df.withColumns({c: na_to_null(col(c), tokens) for c in texts}) if texts else df
    return with_nan_as_null(df)


def infer_types(df: DataFrame) -> T.StructType:
    """Types that every non-missing text of a column can be read as.

    One aggregate over all text columns: whole numbers, else numbers, else
    true/false, else text.
    """
    texts = columns_of(df, "text")
    counts = {}
    for i, c in enumerate(texts):
        v = col(c)
        counts[f"n_{i}"] = F.count(v)
        counts[f"whole_{i}"] = F.count(v.try_cast("bigint"))
        counts[f"number_{i}"] = F.count(F.when(~v.rlike(NUMBER_SUFFIX), v.try_cast("double")))
        counts[f"flag_{i}"] = F.count_if(F.lower(v).isin("true", "false"))
    got = one_row(df, counts)
    found = {}
    for i, c in enumerate(texts):
        n = got[f"n_{i}"]
        if n and got[f"whole_{i}"] == n:
            found[c] = T.LongType()
        elif n and got[f"number_{i}"] == n:
            found[c] = T.DoubleType()
        elif n and got[f"flag_{i}"] == n:
            found[c] = T.BooleanType()
    return T.StructType([T.StructField(f.name, found.get(f.name, f.dataType), True) for f in df.schema])


BAD_LINE = "__bad_line"


def _csv_texts(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> DataFrame:
    """All cells as text, and the whole line where its number of cells is not that of the header."""
    # quotes inside quoted text are doubled, as the usual writers do it
    options = {"header": True, "multiLine": multi_line, "escape": '"', "quote": '"'}
    header = spark.read.csv(path, enforceSchema=False, **options).schema
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in header] + [T.StructField(BAD_LINE, T.StringType())])
    # every file's header is held against the first one's: columns in another order are refused, not swapped
    raw = spark.read.csv(path, schema=names, columnNameOfCorruptRecord=BAD_LINE, enforceSchema=False, **options)
    # the number of cells is known only where all are read: the hash, always at least the least one, asks for them
    whole = F.hash(*[col(f.name) for f in header]) >= -(2**31)
    return raw.withColumn(BAD_LINE, F.when(whole, F.col(BAD_LINE)))


def _cells(line: Column) -> Column:
    """Number of cells of a line; separators within quotes do not count."""
    return F.size(F.split(F.regexp_replace(line, r'"([^"]|"")*"', ""), ","))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = V.NA_TOKENS,
    multi_line: bool = False,
    bad_rows: str = "raise",
) -> DataFrame:
    """CSV with a header; missing texts to NULL, then typed.

    The file is read as text first, as a missing text would spoil the type of
    its column.  Without a schema the types are inferred from all rows, which
    costs one more scan; a given schema saves it.  ``multi_line`` is for line
    breaks inside quotes and makes files unsplittable.

    A line with more cells than the header and a cell that does not read as its
    given type are bad: with ``raise`` the job that reads a column of such a row
    ends and names it, with ``null`` the cell becomes NULL and surplus cells go.
    Lines with fewer cells are filled with NULL.  :func:`csv_rejects` lists all
    three.
    """
    if bad_rows not in ("raise", "null"):
        raise ValueError("bad_rows is raise or null")
    raw = normalise_missing(_csv_texts(spark, path, multi_line), na_tokens)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    target = schema or infer_types(raw.drop(BAD_LINE))
    line = F.col(BAD_LINE)
    n = len(raw.columns) - 1

    def cell(f: T.StructField) -> Column:
        read = col(f.name).try_cast(f.dataType)
        if bad_rows == "null":
            return read.alias(f.name)
        surplus = F.raise_error(F.concat(F.lit(f"more than {n} cells in the line: "), line)).cast(f.dataType)
        kind = f.dataType.simpleString()
        odd = F.raise_error(F.concat(F.lit(f"column {f.name} is no {kind}: "), col(f.name))).cast(f.dataType)
        checked = F.when(line.isNotNull() & (_cells(line) > n), surplus)
        if not isinstance(f.dataType, T.StringType):
            checked = checked.when(col(f.name).isNotNull() & read.isNull(), odd)
        return checked.otherwise(read).alias(f.name)

    return raw.select(*[cell(f) for f in target])


def csv_rejects(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = V.NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """What :func:`read_csv` finds bad: ``file``, ``line``, ``kind``, ``column``, ``value``.

    Kinds are ``surplus`` and ``short`` (the value is the line) and ``unreadable``
    (a cell under the given schema).  Lines are numbered from 1, the header among
    them; numbers come from counts per split, so no file is read in one task.
    With line breaks inside quotes there are no line numbers.
    """
    raw = _csv_texts(spark, path, multi_line)
    names = [c for c in raw.columns if c != BAD_LINE]
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    line, n = F.col(BAD_LINE), len(names)
    kinds = [F.when(line.isNotNull(), F.struct(F.when(_cells(line) > n, "surplus").otherwise("short").alias("kind"),
                                              F.lit(None).cast("string").alias("column"), line.alias("value")))]
    for f in schema or []:
        if not isinstance(f.dataType, T.StringType):
            value = na_to_null(col(f.name), na_tokens)
            bad = value.isNotNull() & value.try_cast(f.dataType).isNull()
            kinds.append(F.when(bad, F.struct(F.lit("unreadable").alias("kind"), F.lit(f.name).alias("column"), col(f.name).alias("value"))))
    # a row is found again by its cells; its line gives the number
    file = F.col("_metadata.file_path")
    found = raw.select(file.alias("file"), F.to_json(F.struct(*[col(c) for c in names])).alias("row"), F.array_compact(F.array(*kinds)).alias("bad"))
    found = found.where(F.size("bad") > 0)
    if multi_line:
        return found.select("file", F.lit(None).cast("bigint").alias("line"), F.inline("bad"))
    lines = _numbered_lines(spark, path)
    fields = ", ".join(f"{quote(c)} string" for c in names)
    parsed = F.from_csv("text", fields, {"quote": '"', "escape": '"'})
    # only the files and rows that are bad meet their lines
    numbered = lines.where("line > 1").withColumn("row", F.to_json(parsed)).select("file", "row", "line")
    once = found.groupBy("file", "row").agg(F.first("bad").alias("bad"))
    return numbered.join(once, ["file", "row"]).select("file", "line", F.inline("bad"))


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their numbers: counts per split are added up, lines stay where they are."""
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), at.alias("at")
    )
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits.withColumn("before", before), ["file", "split"])
    # blank lines count as lines but hold no row
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text").where(F.trim("text") != "")


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    """One table; CSV goes through :func:`read_csv`."""
    if format == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    return with_nan_as_null(reader.load(path))


def read_tables(spark: SparkSession, paths: Mapping[str, str], format: str = "parquet") -> dict[str, DataFrame]:
    """Several named inputs held together (S3)."""
    return {name: read_table(spark, path, format) for name, path in paths.items()}


def require_rows(df: DataFrame, name: str = "table") -> DataFrame:
    """Refuse an empty table (S1); looks at one row."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def with_status(df: DataFrame) -> DataFrame:
    """Loaded data with a status of 0 in every row."""
    return reset_status(df)


def final_table(spark: SparkSession, in_memory: DataFrame | None, path: str, format: str = "parquet") -> DataFrame:
    """The final table: the one at hand, else the stored one."""
    return in_memory if in_memory is not None else read_table(spark, path, format)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Flag table from JSON, with defaults for absent fields."""
    stored = spark.read.schema(ISSUE_SCHEMA).json(path)
    return stored.select("flag_value", *issue_fields(F.lit(""), F.lit("")))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Detection rules from JSON, in flag order (S8); a set of more than 63 is refused."""
    stored = spark.read.schema(RULE_SCHEMA).json(path)
    n = stored.count()
    if n > V.MAX_FLAGS:
        raise ValueError(f"a status holds at most {V.MAX_FLAGS} flags; {path} has {n} rules")
    rows = stored.orderBy("flag_value").collect()
    return [
        Rule(r["detection_code"], tuple(r["columns"] or ()), r["explanation"] or "", r["flag_value"],
             r["category"] or V.UNKNOWN_CATEGORY, r["severity"] or V.DEFAULT_SEVERITY,
             r["test_description"] or "", r["safety_notes"] or "")
        for r in rows
    ]
