"""Profiles (A1-A6, A10-A13, P7-P9, P12, P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import values as V
from dqspark.operators import profile
from dqspark.operators.clean import drop_duplicates
from dqspark.operators.columns import schema_summary as summary_of
from dqspark.operators.columns import value_kinds as kinds_of
from dqspark.operators.flags import flag_rows
from dqspark.operators.rules import negative
from dqspark.session import new_folder
from dqspark.queries.registry import EVENTS_N_CTE, events_n, query, table

EVENT_TYPES = {
    "event_id": "bigint", "user_id": "bigint", "ts": "timestamp_ntz", "event_type": "string", "value_n": "double",
    "user_n": "bigint", "type_n": "string", "ts_n": "timestamp_ntz", "sparse_n": "double", "yesno_n": "string",
    "fare": "double",
}
WITH_GAPS = ["value_n", "user_n", "type_n", "ts_n", "sparse_n", "yesno_n"]
NUMBERS = ("bigint", "double", "int")


def _missing(names) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in names)


@query(EVENTS_N_CTE + f"""
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(sum({_missing(EVENT_TYPES)}) AS BIGINT) AS n_missing
FROM events_n
""")
def profile_table(spark, sf_dir):
    return profile.table_profile(events_n(spark, sf_dir))


@query("""
SELECT 'Original' AS stage, count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS n_missing,
  CAST(NULL AS BIGINT) AS flagged_rows FROM supplier
UNION ALL SELECT 'Distinct', count(*), 2, 0, NULL FROM (SELECT DISTINCT s_nationkey, s_acctbal FROM supplier)
UNION ALL SELECT 'Flagged', count(*), 3, 0, count(*) FILTER (WHERE s_acctbal < 0)
FROM (SELECT DISTINCT s_nationkey, s_acctbal FROM supplier)
""")
def stage_compare(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    second = drop_duplicates(first)
    third = flag_rows(second, [negative("s_acctbal")]).data
    return profile.stage_compare({"Original": first, "Distinct": second, "Flagged": third}).drop("position")


def _samples(column: str, n: int, source: str = "events_n") -> str:
    return (
        f"(SELECT string_agg(v, '; ' ORDER BY v) FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v "
        f"FROM {source} WHERE {column} IS NOT NULL ORDER BY v LIMIT {n}))"
    )


def _missing_sql(column: str) -> str:
    dtype = EVENT_TYPES[column]
    numeric = dtype in NUMBERS
    says = {k: "'" + v + "'" for k, v in V.SUGGESTIONS.items()}
    pct = f"(100.0 * (count(*) - count({column})) / count(*))"
    skew = f"skewness({column})" if numeric else "CAST(NULL AS DOUBLE)"
    low = says["median_low"] if numeric else says["mode_low"]
    if numeric:
        rest = (f"CASE WHEN count({column}) <= 3 THEN {says['median_few']} WHEN abs({skew}) < 0.5 THEN {says['mean']} "
                f"ELSE {says['median_skewed']} END")
    elif dtype == "string":
        rest = (f"CASE WHEN count(DISTINCT {column}) < 0.1 * count({column}) THEN {says['mode_text']} "
                f"ELSE {says['constant']} END")
    else:
        rest = says["datetime"]
    return f"""
SELECT '{column}' AS "column", '{dtype}' AS dtype, count(*) - count({column}) AS missing_count,
  round({pct}, 4) AS missing_pct, printf('%.1f%%', {pct}) AS missing_pct_text,
  count(DISTINCT {column}) AS n_distinct, {_samples(column, 5)} AS samples, round({skew}, 4) AS skewness,
  CASE WHEN {pct} > 50 THEN {says['drop']} WHEN {pct} < 5 THEN {low} ELSE {rest} END AS suggested_strategy
FROM events_n"""


@query(EVENTS_N_CTE + " UNION ALL ".join(_missing_sql(c) for c in WITH_GAPS))
def profile_columns(spark, sf_dir):
    found = profile.missing_profile(events_n(spark, sf_dir))
    return found.select(
        "column", "dtype", "missing_count", F.round("missing_pct", 4).alias("missing_pct"), "missing_pct_text",
        "n_distinct", F.array_join("samples", "; ").alias("samples"), F.round("skewness", 4).alias("skewness"),
        "suggested_strategy",
    )


LINE_TYPES = {"l_quantity": "double", "l_extendedprice": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz"}
LINE_GAPS = {"l_quantity": 20, "l_extendedprice": 3, "l_returnflag": 6, "l_shipdate": 5}


def _suggest_sql(column: str) -> str:
    says = {k: "'" + v + "'" for k, v in V.SUGGESTIONS.items()}
    rest = {
        "double": f"CASE WHEN abs(skewness({column})) < 0.5 THEN {says['mean']} ELSE {says['median_skewed']} END",
        "string": f"CASE WHEN count(DISTINCT {column}) < 0.1 * count({column}) THEN {says['mode_text']} "
                  f"ELSE {says['constant']} END",
        "timestamp_ntz": says["datetime"],
    }[LINE_TYPES[column]]
    low = says["median_low"] if LINE_TYPES[column] == "double" else says["mode_low"]
    return f"""
SELECT '{column}' AS "column", CASE WHEN 100.0 * count({column}) / count(*) < 50 THEN {says['drop']}
  WHEN 100.0 * count({column}) / count(*) > 95 THEN {low} ELSE {rest} END AS suggested_strategy FROM lines"""


@query("WITH lines AS (SELECT " + ", ".join(
    f"CASE WHEN l_orderkey % {n} = 0 THEN NULL ELSE {c} END AS {c}" for c, n in LINE_GAPS.items())
    + " FROM lineitem)" + " UNION ALL ".join(_suggest_sql(c) for c in LINE_TYPES))
def suggest_strategy(spark, sf_dir):
    """Suggested fills for columns with different gaps (A4, A10)."""
    lines = table(spark, sf_dir, "lineitem")
    gaps = [F.when(F.col("l_orderkey") % n != 0, F.col(c)).alias(c) for c, n in LINE_GAPS.items()]
    return profile.missing_profile(lines.select(*gaps)).select("column", "suggested_strategy")


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def _info_sql(column: str, dtype: str) -> str:
    numeric = dtype in NUMBERS
    number = [f"CAST({f}({column}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)" for f in ("min", "max", "avg")]
    samples = _samples(column, 3, "orders") if dtype == "string" else "CAST(NULL AS VARCHAR)"
    return f"""
SELECT '{column}' AS "column", '{dtype}' AS dtype, count(*) - count({column}) AS null_count,
  count(DISTINCT {column}) AS unique_count, {number[0]} AS "min", {number[1]} AS "max", round({number[2]}, 4) AS mean,
  {samples} AS samples FROM orders"""


@query(" UNION ALL ".join(_info_sql(c, t) for c, t in ORDER_TYPES.items()))
def column_info(spark, sf_dir):
    found = profile.column_info(table(spark, sf_dir, "orders"))
    return found.select(
        "column", "dtype", "null_count", "unique_count", "min", "max", F.round("mean", 4).alias("mean"),
        F.array_join("samples", "; ").alias("samples"),
    )


@query("""
SELECT 'o_orderkey(bigint), o_custkey(bigint), o_orderstatus(string), o_totalprice(double), '
  || 'o_orderdate(timestamp_ntz), o_orderpriority(string)' AS columns, CAST(6 AS BIGINT) AS n_columns,
  count(*) AS n_rows FROM orders
""")
def schema_summary(spark, sf_dir):
    return summary_of(table(spark, sf_dir, "orders"))


@query("""
SELECT 'doc_id' AS "column", 'bigint' AS dtype, 'numeric' AS family, bool_or(doc_id = 1) AND bool_or(doc_id = 0)
  AS boolean_like, false AS datetime_like FROM documents
UNION ALL SELECT 'day_text', 'string', 'text', false, count(*) > 0 FROM documents
UNION ALL SELECT 'lang', 'string', 'text', bool_and(upper(lang) IN ('Y', 'N')), false FROM documents
UNION ALL SELECT 'quality', 'string', 'text', bool_and(quality IN (0, 1)), false FROM labels
UNION ALL SELECT 'labelled', 'boolean', 'boolean', count(*) > 0, false FROM documents
""")
def value_kinds(spark, sf_dir):
    """Families and boolean-like / datetime-like columns.

    A column that holds both values of a pair counts as boolean-like, whatever
    else it holds, so an identifier with 0 and 1 does too.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = documents.join(labels, "doc_id", "left").select(
        "doc_id", F.date_format(F.date_from_unix_date((F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("day_text"),
        "lang", "quality", F.col("quality").isNotNull().alias("labelled"),
    )
    return kinds_of(joined)


def _phi_sql(a: str, b: str) -> str:
    return f"""
SELECT '{a}' AS column1, '{b}' AS column2,
  (n * n11 - n1 * n2) / (sqrt(CAST(n1 AS DOUBLE) * (n - n1)) * sqrt(CAST(n2 AS DOUBLE) * (n - n2))) AS c
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE {a} IS NULL) AS n1,
  count(*) FILTER (WHERE {b} IS NULL) AS n2, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS n11 FROM events_n)"""


@query(
    EVENTS_N_CTE + "SELECT column1, column2, round(c, 4) AS correlation FROM ("
    + " UNION ALL ".join(_phi_sql(a, b) for i, a in enumerate(WITH_GAPS) for b in WITH_GAPS[i + 1:])
    + ") WHERE abs(c) > 0.3"
)
def missing_corr(spark, sf_dir):
    found = profile.missing_correlation(events_n(spark, sf_dir), threshold=0.3)
    return found.withColumn("correlation", F.round("correlation", 4))


@query(EVENTS_N_CTE + f"""
SELECT count(*) FILTER (WHERE {_missing(EVENT_TYPES)} > 1) AS rows_multiple_missing,
  count(*) FILTER (WHERE {_missing(EVENT_TYPES)} = 11) AS completely_empty_rows FROM events_n
""")
def missing_rows(spark, sf_dir):
    return profile.missing_rows(events_n(spark, sf_dir))


def _quartile_sql(column: str) -> str:
    q1, q2, q3 = (f"quantile_cont({column}, {p})" for p in (0.25, 0.5, 0.75))
    figures = {"q1": q1, "median": q2, "q3": q3, "low_fence": f"{q1} - 1.5 * ({q3} - {q1})",
               "high_fence": f"{q3} + 1.5 * ({q3} - {q1})", "ceiling": f"{q3} * 10"}
    return f"SELECT '{column}' AS \"column\", " + ", ".join(f"round({e}, 4) AS {n}" for n, e in figures.items()) + " FROM lineitem"


@query(" UNION ALL ".join(_quartile_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def quartiles(spark, sf_dir):
    found = profile.quartiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


@query("""
WITH a AS (SELECT o_custkey AS c, o_orderpriority AS p FROM orders), b AS (SELECT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_totalprice > 150000),
v AS (SELECT 'o_custkey' AS "column", CAST(c AS VARCHAR) AS v, 1 AS stage FROM a UNION SELECT 'o_custkey', CAST(c AS VARCHAR), 2 FROM b
  UNION SELECT 'o_orderpriority', p, 1 FROM a UNION SELECT 'o_orderpriority', p, 2 FROM b),
s AS (SELECT "column", v, bool_or(stage = 1) AS in1, bool_or(stage = 2) AS in2 FROM v WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT "column", count(*) FILTER (in1) AS distinct_before, count(*) FILTER (in2) AS distinct_after, count(*) FILTER (in1 AND in2) AS kept,
  count(*) FILTER (in1 AND NOT in2) AS lost, count(*) FILTER (in2 AND NOT in1) AS new, count(*) AS distinct_either
FROM s GROUP BY 1
""")
def stage_distincts(spark, sf_dir):
    """Distinct values a filter keeps and loses, from stored sketches of both stages; the first stage's parts are merged (A2, A3)."""
    orders = table(spark, sf_dir, "orders")
    names = ["o_custkey", "o_orderpriority"]
    log = 18  # sketches of up to 2^18 values are exact
    parts = [profile.distinct_sketches(orders.where(F.col("o_orderkey") % 2 == i), names, log) for i in range(2)]
    folder = new_folder(spark)
    parts[0].unionByName(parts[1]).write.parquet(f"{folder}/parts")
    before = profile.merge_sketches(spark.read.parquet(f"{folder}/parts"), log)
    after = profile.distinct_sketches(orders.where("o_totalprice > 150000"), names, log)
    return profile.compare_sketches(before, after, log)
