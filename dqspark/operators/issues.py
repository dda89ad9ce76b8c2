"""Issue records: scores, renaming, display, JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.functions.text import title_case, truncate
from dqspark.operators.columns import col
from dqspark.operators.flags import ISSUE_SCHEMA, issue_fields


def quality_score(n_issues, supplied=None):
    """Given score, else 100 less 15 per issue, at least 10."""
    computed = F.greatest(F.lit(100) - n_issues * 15, F.lit(10))
    return computed if supplied is None else F.coalesce(supplied, computed)


def issue_metrics(issues: DataFrame, supplied: int | None = None) -> DataFrame:
    """Number of issues, of severe ones, of categories, and the score, a supplied one if there is."""
    given = None if supplied is None else F.lit(supplied)
    return issues.agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.lower("severity") == "high").alias("high_severity"),
        F.count_distinct("category").alias("n_categories"),
        quality_score(F.count("*"), given).cast("bigint").alias("data_quality_score"),
    )


def rename_in_issues(issues: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Carry renamed columns into the issues: the column list by name, the texts
    by replacing one old name after the other (P4)."""
    if not mapping:
        return issues
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    description, fix = F.col("description"), F.col("fix_approach")
    for old, new in mapping.items():
        description = F.replace(description, F.lit(old), F.lit(new))
        fix = F.replace(fix, F.lit(old), F.lit(new))
    columns = F.transform("affected_columns", lambda c: F.coalesce(F.try_element_at(names, c), c))
    return issues.withColumns({"affected_columns": columns, "description": description, "fix_approach": fix})


def shown(issues: DataFrame, description_length: int = 100, fix_length: int = 80) -> DataFrame:
    """Issues as a table for people."""
    return issues.select(
        "flag_value",
        title_case(F.col("category")).alias("category"),
        title_case(F.col("severity")).alias("severity"),
        truncate(F.col("description"), description_length, "...", description_length).alias("description"),
        F.array_join("affected_columns", ", ").alias("affected_columns"),
        truncate(F.col("fix_approach"), fix_length, "...", fix_length).alias("fix_approach"),
    )


def to_json(issues: DataFrame) -> DataFrame:
    """One JSON text per issue."""
    return issues.select("flag_value", F.to_json(F.struct(*issues.columns)).alias("json"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Issues from JSON texts."""
    return df.select(F.from_json(column, ISSUE_SCHEMA).alias("i")).select("i.*")


# --- whole result records -----------------------------------------------------

ISSUE_TYPE = "struct<description: string, category: string, severity: string, affected_columns: array<string>, fix_approach: string>"
RECORD_FIELDS = ("total_issues", "issues", "column_renaming", "recommendations", "data_quality_score")


def _texts(value: Column, path: str) -> Column:
    """A list of texts; a single text is a list of one, anything else is absent."""
    single = F.try_variant_get(value, path, "string")
    return F.coalesce(F.try_variant_get(value, path, "array<string>"), F.when(~F.startswith(single, F.lit("[")) & ~F.startswith(single, F.lit("{")), F.array(single)))


def read_records(df: DataFrame, column: str = "json", columns: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Result records of an analysis from JSON texts whose shape varies.

    Each text is parsed once, as a variant; a field that is absent or of another
    kind gets its default: no issues, renamings or recommendations, as many issues
    as are listed, a score of 85 if none is given and a computed one if it is
    null.  Fields of single issues have the defaults of the flag table.  Every
    name in ``columns`` has a renaming, at least to itself.  ``valid`` tells
    whether the text was an object; all others have only defaults.
    """
    v = F.col("__v")
    parsed = df.withColumn("__v", F.try_parse_json(col(column)))
    valid = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))

    def issue(i: Column) -> Column:
        raw = F.struct(
            *[F.try_variant_get(i, f"$.{f}", "string").alias(f) for f in ("description", "category", "severity", "fix_approach")],
            _texts(i, "$.affected_columns").alias("affected_columns"),
        )
        return raw

    listed = F.coalesce(F.try_variant_get(v, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
    given = F.transform(listed, issue)
    filled = F.transform(
        given,
        lambda g, i: F.struct(
            F.coalesce(g["description"], F.concat(F.lit("Issue "), (i + 1).cast("string"))).alias("description"),
            F.coalesce(g["category"], F.lit(V.UNKNOWN_CATEGORY)).alias("category"),
            F.coalesce(g["severity"], F.lit(V.DEFAULT_SEVERITY)).alias("severity"),
            F.coalesce(g["affected_columns"], F.array().cast("array<string>")).alias("affected_columns"),
            F.coalesce(g["fix_approach"], F.lit(V.DEFAULT_FIX)).alias("fix_approach"),
        ),
    )
    total = F.coalesce(F.try_variant_get(v, "$.total_issues", "bigint"), F.size(listed).cast("bigint"))
    score = F.try_variant_get(v, "$.data_quality_score", "bigint")
    # a score that is there but null is computed, one that is absent has a fixed default
    there = F.array_contains(F.coalesce(F.json_object_keys(col(column)), F.array().cast("array<string>")), "data_quality_score")
    computed = quality_score(F.col("total_issues"))
    renaming = F.coalesce(F.try_variant_get(v, "$.column_renaming", "map<string,string>"), F.create_map().cast("map<string,string>"))
    if columns:
        own = F.create_map(*[F.lit(x) for c in columns for x in (c, c)])
        missing = F.map_filter(own, lambda k, _: ~F.map_contains_key(renaming, k))
        renaming = F.map_concat(renaming, missing)
    out = parsed.select(
        *[col(k) for k in keep], valid.alias("valid"), total.alias("total_issues"), filled.cast(f"array<{ISSUE_TYPE}>").alias("issues"),
        renaming.alias("column_renaming"),
        F.coalesce(_texts(v, "$.recommendations"), F.array().cast("array<string>")).alias("recommendations"),
        score.alias("__score"), there.alias("__there"),
    )
    final = F.coalesce(F.col("__score"), F.when(F.col("__there"), computed).otherwise(F.lit(V.DEFAULT_SCORE)))
    return out.withColumn("data_quality_score", final.cast("bigint")).drop("__score", "__there")


def record_json(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records as JSON texts, which :func:`read_records` reads again."""
    return records.select(*[col(k) for k in keep], F.to_json(F.struct(*RECORD_FIELDS)).alias("json"))


def record_issues(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The issues of records as flag-table rows, the i-th of a record with the i-th bit.

    Beyond the bits of one status flags go on in further words, as in
    ``wideflags``: ``flag_value`` is the bit within the word ``flag_word``.
    """
    rows = records.select(*[col(k) for k in keep], F.posexplode("issues").alias("__i", "__issue"))
    word = F.floor(F.col("__i") / V.MAX_FLAGS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__i") - word * V.MAX_FLAGS)
    fields = issue_fields(F.lit(""), F.lit(V.DEFAULT_FIX), "__issue.")
    return rows.select(*[col(k) for k in keep], bit.alias("flag_value"), *fields, word.alias("flag_word"))
