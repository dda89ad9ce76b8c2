"""Text cleaning (F1-F9, A14) and coercions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.coerce import to_flag, to_number, to_time
from dqspark.functions.text import item_count, percent_text, set_case
from dqspark.operators import clean
from dqspark.queries.registry import (
    BOOKINGS_CTE,
    bookings,
    duck_clean,
    duck_items,
    duck_title,
    duck_trim,
    query,
    table,
)
from dqspark.session import new_folder


@query(f"SELECT doc_id, lang, source, nullif({duck_clean('text')}, '') AS text FROM documents")
def clean_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return clean.clean_text(documents)


@query(f"SELECT o_orderkey, {duck_title('o_orderpriority')} AS o_orderpriority FROM orders")
def case_title(spark, sf_dir):
    return clean.set_case(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "title")


@query("SELECT p_partkey, upper(p_type) AS p_type, upper(p_name) AS p_upper, lower(p_brand) AS p_lower FROM part")
def case_upper_lower(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    upper, lower = (lambda c: set_case(F.col(c), "upper")), (lambda c: set_case(F.col(c), "lower"))
    return part.select(
        "p_partkey", upper("p_type").alias("p_type"), upper("p_name").alias("p_upper"), lower("p_brand").alias("p_lower")
    )


def prefix_sql(source: str, key: str, column: str, threshold=0.85, max_length=12, min_length=3, legacy="") -> str:
    """SQL that finds and cuts the prefix of one column.

    ``legacy`` is empty, ``token`` or ``letters`` for the two older rules.
    """
    common = "list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: lo[:i] = hi[:i]))"
    starts = "count(*) FILTER (WHERE lower(s[:length(cand)]) = cand)"
    if legacy == "token":
        by_token, by_letters = f"(SELECT count(token) FROM t) >= {threshold} * count(*)", "false"
    else:
        by_token = (
            f"count(*) FILTER (WHERE starts_with(s, token || '_')) >= {threshold} * count(*) "
            f"AND length(any_value(token)) >= {min_length}"
        )
        by_letters = f"any_value(length(cand)) >= {min_length} AND {starts} >= {threshold} * count(*) AND "
        if legacy == "letters":
            by_token = "false"
            by_letters += (
                "count(*) FILTER (WHERE length(s) > length(cand)) >= 0.9 * count(*) "
                f"AND count(letters) >= {threshold} * count(*)"
            )
        else:
            by_letters += (
                "count(*) FILTER (WHERE lower(s[:length(cand)]) = cand AND length(s) > length(cand)) "
                f">= 0.9 * {starts}"
            )
    return f"""
WITH t AS (
  SELECT {key}, {duck_trim(column)} AS s,
    nullif(regexp_extract({duck_trim(column)}, '^([A-Za-z]+)_', 1), '') AS token,
    nullif(lower(regexp_extract({duck_trim(column)}, '^([A-Za-z]+)', 1)), '') AS letters
  FROM {source}
), top AS (
  SELECT (SELECT token FROM t WHERE token IS NOT NULL GROUP BY token ORDER BY count(*) DESC, token LIMIT 1) AS token
), ends AS (SELECT coalesce(min(letters), '') AS lo, coalesce(max(letters), '') AS hi FROM t),
glued AS (SELECT lo[:least({common}, {max_length})] AS cand FROM ends),
fit AS (
  SELECT coalesce({by_token}, false) AS by_token, any_value(token) AS token, {by_letters} AS by_letters,
    any_value(cand) AS cand
  FROM (SELECT t.s, t.letters, top.token, glued.cand FROM t, top, glued)
)
SELECT {key}, CASE
  WHEN by_token AND starts_with(s, fit.token || '_') THEN s[length(fit.token) + 2:]
  WHEN by_token THEN s
  WHEN by_letters AND lower(s[:length(cand)]) = cand THEN s[length(cand) + 1:]
  ELSE s END AS {column}
FROM t, fit"""


def _strip(df, column, finder=clean.find_prefixes, **options):
    return clean.strip_prefixes(df, finder(df, [column], **options))


@query(prefix_sql("customer", "c_custkey", "c_name"))
def strip_prefix(spark, sf_dir):
    """Glued prefix; the separator behind it stays."""
    return _strip(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")


@query(BOOKINGS_CTE + prefix_sql("bookings", "booking_id", "loc").replace("WITH t", ", t", 1))
def strip_prefix_token(spark, sf_dir):
    """Token with underscore on 96% of the rows."""
    return _strip(bookings(spark, sf_dir).select("booking_id", "loc"), "loc")


@query(BOOKINGS_CTE + prefix_sql("bookings", "booking_id", "gate").replace("WITH t", ", t", 1))
def strip_prefix_glued(spark, sf_dir):
    return _strip(bookings(spark, sf_dir).select("booking_id", "gate"), "gate")


@query(prefix_sql("part", "p_partkey", "p_name"))
def strip_prefix_none(spark, sf_dir):
    """A column without a common prefix stays as it is."""
    return _strip(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


@query(BOOKINGS_CTE + prefix_sql("bookings", "booking_id", "loc", 0.95, legacy="token").replace("WITH t", ", t", 1))
def strip_prefix_legacy(spark, sf_dir):
    return _strip(bookings(spark, sf_dir).select("booking_id", "loc"), "loc", clean.find_token_prefixes)


@query(prefix_sql("customer", "c_custkey", "c_name", 0.95, 10, legacy="letters"))
def strip_alpha_legacy(spark, sf_dir):
    return _strip(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", clean.find_letter_prefixes)


@query("SELECT DISTINCT lang, source, text FROM documents")
def dedupe(spark, sf_dir):
    return clean.drop_duplicates(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedupe_hot(spark, sf_dir):
    """Few distinct rows, each very often."""
    return clean.drop_duplicates(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(f"""
SELECT {duck_title(duck_clean('p_name'))} AS p_name, {duck_title("p_brand[length('Brand') + 1:]")} AS p_brand,
  {duck_title(duck_clean('p_type'))} AS p_type, p_size
FROM (SELECT DISTINCT p_name, p_brand, p_type, p_size FROM part)
""")
def basic_clean(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size")
    return clean.basic_clean(part, store=new_folder(spark)).data


@query("""
WITH d AS (SELECT DISTINCT p_name, p_brand, p_type, p_size FROM part)
SELECT 'remove_duplicates' AS operation, NULL AS "column",
  'Removed ' || ((SELECT count(*) FROM part) - (SELECT count(*) FROM d)) || ' duplicate rows' AS detail,
  CAST(NULL AS DOUBLE) AS pct_rows, true AS success
UNION ALL SELECT 'clean_text', NULL, 'Cleaned text in 3 columns', NULL, true
UNION ALL SELECT 'strip_uniform_prefixes', 'p_brand', 'brand',
  round(100.0 * (SELECT count(*) FROM d WHERE starts_with(lower(p_brand), 'brand')) / (SELECT count(*) FROM d), 2), true
UNION ALL SELECT 'standardize_case', NULL, 'Standardized case in 3 columns to title', NULL, true
""")
def cleaning_report(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size")
    return clean.basic_clean(part).report(spark)


@query(BOOKINGS_CTE + f"""
SELECT booking_id, try_cast(loc AS DOUBLE) AS loc_number, try_cast(layovers AS DOUBLE) AS layovers_number,
  try_cast(substr(CAST(start_date AS VARCHAR), 1, 10) || CASE WHEN booking_id % 4 = 0 THEN 'x' ELSE '' END AS TIMESTAMP)
    AS start_time,
  lower(trim(window_seat)) IN ('true', 't', 'yes', 'y', '1') AS window_flag,
  CAST({duck_items('layover_locations')} AS INTEGER) AS n_layovers,
  printf('%.1f%%', 100.0 * base_fare / total_fare) AS base_share
FROM bookings
""")
def coercions(spark, sf_dir):
    """Texts to numbers, times, flags and counts; bad texts to NULL."""
    df = bookings(spark, sf_dir)
    dirty = F.concat(F.date_format("start_date", "yyyy-MM-dd"), F.when(F.col("booking_id") % 4 == 0, "x").otherwise(""))
    return df.select(
        "booking_id",
        to_number(F.col("loc")).alias("loc_number"),
        to_number(F.col("layovers")).alias("layovers_number"),
        to_time(dirty).alias("start_time"),
        to_flag(F.col("window_seat")).alias("window_flag"),
        item_count(F.col("layover_locations")).alias("n_layovers"),
        percent_text(100.0 * F.col("base_fare") / F.col("total_fare")).alias("base_share"),
    )
