"""Missing-value fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import impute, ordered
from dqspark.operators.impute import Strategy
from dqspark.operators.profile import imputation_totals, validate_imputation
from dqspark.queries.registry import BOOKINGS_CTE, EVENTS_N_CTE, bookings, events_n, query, table


def _mode(column: str) -> str:
    return (f"(SELECT {column} FROM events_n WHERE {column} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 4) for c in names})


@query(EVENTS_N_CTE + """
SELECT event_id, round(coalesce(value_n, (SELECT avg(value_n) FROM events_n)), 4) AS value_n,
  round(coalesce(user_n, (SELECT avg(user_n) FROM events_n)), 4) AS user_n FROM events_n
""")
def impute_mean(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n", "user_n")
    return _rounded(impute.fill_numeric(df, ["value_n", "user_n"], Strategy.MEAN), "value_n", "user_n")


@query(EVENTS_N_CTE + """
SELECT event_id, round(coalesce(value_n, (SELECT median(value_n) FROM events_n)), 4) AS value_n,
  round(coalesce(user_n, (SELECT median(user_n) FROM events_n)), 4) AS user_n FROM events_n
""")
def impute_median(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n", "user_n")
    return _rounded(impute.fill_numeric(df, ["value_n", "user_n"]), "value_n", "user_n")


@query(EVENTS_N_CTE + f"""
SELECT event_id, coalesce(type_n, {_mode('type_n')}) AS type_n, coalesce(user_n, {_mode('user_n')}) AS user_n
FROM events_n
""")
def impute_mode(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "type_n", "user_n")
    return impute.fit(df, {"type_n": Strategy.MODE, "user_n": Strategy.MODE}).transform(df)


@query(EVENTS_N_CTE + """
SELECT event_id, coalesce(value_n, 0) AS value_n, coalesce(type_n, 'Unknown') AS type_n FROM events_n
""")
def impute_constant(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n", "type_n")
    return impute.fit(df, {"value_n": Strategy.CONSTANT, "type_n": Strategy.CONSTANT}).transform(df)


@query(EVENTS_N_CTE + """
SELECT event_id, coalesce(yesno_n, 'No') AS yesno_n,
  coalesce(CASE WHEN value_n IS NOT NULL THEN value_n > 10 END, false) AS big_n FROM events_n
""")
def impute_boolean(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "yesno_n", (F.col("value_n") > 10).alias("big_n"))
    return impute.fill_boolean(df, ["yesno_n", "big_n"])


@query(EVENTS_N_CTE + "SELECT event_id, value_n, type_n FROM events_n WHERE value_n IS NOT NULL AND type_n IS NOT NULL")
def impute_drop(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n", "type_n")
    return impute.fit(df, {"value_n": Strategy.DROP, "type_n": Strategy.DROP}).transform(df)


@query(EVENTS_N_CTE + f"""
SELECT event_id, user_id, ts, event_type,
  round(coalesce(value_n, (SELECT median(value_n) FROM events_n)), 4) AS value_n,
  round(coalesce(user_n, (SELECT avg(user_n) FROM events_n)), 4) AS user_n,
  coalesce(type_n, {_mode('type_n')}) AS type_n,
  last_value(ts_n IGNORE NULLS) OVER (ORDER BY event_id) AS ts_n,
  round(coalesce(sparse_n, (SELECT median(sparse_n) FROM events_n)), 4) AS sparse_n,
  coalesce(yesno_n, {_mode('yesno_n')}) AS yesno_n, round(fare, 4) AS fare
FROM events_n
""")
def impute_all(spark, sf_dir):
    """Every column by the default of its type, one by the caller's wish."""
    df = events_n(spark, sf_dir)
    filled = impute.fit_all(df, {"user_n": Strategy.MEAN}, order_by=["event_id"]).transform(df)
    return _rounded(filled, "value_n", "user_n", "sparse_n", "fare")


@query(EVENTS_N_CTE + """
SELECT event_id, last_value(value_n IGNORE NULLS) OVER (ORDER BY event_id) AS value_n,
  last_value(type_n IGNORE NULLS) OVER (ORDER BY event_id) AS type_n FROM events_n
""")
def ffill(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n", "type_n")
    return ordered.fill_ordered(df, {"value_n": "forward_fill", "type_n": "forward_fill"}, ["event_id"])


@query(EVENTS_N_CTE + """
SELECT event_id, user_id, last_value(sparse_n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS sparse_n
FROM events_n
""")
def ffill_by_user(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "user_id", "sparse_n")
    return ordered.fill_ordered(df, {"sparse_n": "forward_fill"}, ["event_id"], ["user_id"])


@query(EVENTS_N_CTE + """
SELECT event_id, first_value(value_n IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING) AS value_n FROM events_n
""")
def bfill(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "value_n")
    return ordered.fill_ordered(df, {"value_n": "backward_fill"}, ["event_id"])


def _line_sql(column: str, by: str = "", number: str = "") -> str:
    number = number or f"CAST({column} AS DOUBLE)"
    part = f"PARTITION BY {by} " if by else ""
    before = f"OVER ({part}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER ({part}ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
, p AS (SELECT event_id, user_id, {number} AS v, row_number() OVER ({part}ORDER BY event_id) AS i FROM events_n),
w AS (SELECT event_id, user_id, v, i, last_value(v IGNORE NULLS) {before} AS pv,
  last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) {before} AS pi,
  first_value(v IGNORE NULLS) {after} AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) {after} AS ni
  FROM p),
line AS (SELECT event_id, user_id, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NOT NULL AND nv IS NOT NULL
  THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE pv END AS v FROM w)
"""


@query(EVENTS_N_CTE + _line_sql("sparse_n") + "SELECT event_id, round(v, 4) AS sparse_n FROM line")
def interpolate(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "sparse_n")
    return _rounded(ordered.fill_ordered(df, {"sparse_n": "interpolate"}, ["event_id"]), "sparse_n")


@query(EVENTS_N_CTE + _line_sql("value_n", "user_id") + "SELECT event_id, user_id, round(v, 4) AS value_n FROM line")
def interpolate_by_user(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "user_id", "value_n")
    return _rounded(ordered.fill_ordered(df, {"value_n": "interpolate"}, ["event_id"], ["user_id"]), "value_n")


@query(EVENTS_N_CTE + _line_sql("ts_n", number="CAST(epoch_us(ts_n) AS DOUBLE)")
       + "SELECT event_id, make_timestamp(CAST(round(v) AS BIGINT)) AS ts_n FROM line")
def interpolate_ts(spark, sf_dir):
    df = events_n(spark, sf_dir).select("event_id", "ts_n")
    return impute.fill_datetime(df, ["event_id"], ["ts_n"], Strategy.INTERPOLATE)


@query(BOOKINGS_CTE + """
, t AS (SELECT booking_id, try_cast(CASE WHEN booking_id % 8 <> 3 THEN strftime(start_date, '%Y-%m-%d') END AS TIMESTAMP)
  AS day_text FROM bookings)
SELECT booking_id, first_value(day_text IGNORE NULLS) OVER (ORDER BY booking_id ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING) AS day_text FROM t
""")
def datetime_text_fill(spark, sf_dir):
    """Texts that look like dates are read as time, then filled."""
    text = F.when(F.col("booking_id") % 8 != 3, F.date_format("start_date", "yyyy-MM-dd")).alias("day_text")
    df = bookings(spark, sf_dir).select("booking_id", text)
    return impute.fill_datetime(df, ["booking_id"], strategy=Strategy.BACKWARD_FILL)


def _validate_sql(column: str, fill: str, number: bool) -> str:
    low, high = (f"CAST({f}({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    low2, high2 = (f"CAST({f}({fill}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    return f"""
SELECT '{column}' AS "column", b AS missing_before, a AS missing_after, b - a AS missing_reduction,
  CASE WHEN b > 0 AND a = 0 THEN 'fully' WHEN b > 0 AND a < b THEN 'partially' WHEN b > 0 THEN 'not'
       ELSE 'complete before' END AS filled,
  coalesce(lo2 < lo OR hi2 > hi, false) AS outside_range, round(lo, 4) AS min_before, round(hi, 4) AS max_before,
  round(lo2, 4) AS min_after, round(hi2, 4) AS max_after
FROM (SELECT count(*) FILTER (WHERE {column} IS NULL) AS b, count(*) FILTER (WHERE ({fill}) IS NULL) AS a,
  {low} AS lo, {high} AS hi, {low2} AS lo2, {high2} AS hi2 FROM filled)"""


@query(
    EVENTS_N_CTE
    + """, filled AS (SELECT event_id, value_n, type_n, ts_n, fare, value_f, ts_f FROM (SELECT *,
  coalesce(value_n, 0) AS value_f, last_value(ts_n IGNORE NULLS) OVER (ORDER BY event_id DESC) AS ts_f FROM events_n))"""
    + " UNION ALL ".join([
        _validate_sql("event_id", "event_id", True), _validate_sql("value_n", "value_f", True),
        _validate_sql("type_n", "type_n", False), _validate_sql("ts_n", "ts_f", False), _validate_sql("fare", "fare", True)])
)
def impute_validate(spark, sf_dir):
    """A constant of 0 leaves the range; type_n is skipped."""
    df = events_n(spark, sf_dir).select("event_id", "value_n", "type_n", "ts_n", "fare")
    plan = {"value_n": Strategy.CONSTANT, "type_n": Strategy.SKIP, "ts_n": Strategy.BACKWARD_FILL}
    filled = impute.fit(df, plan, order_by=["event_id"]).transform(df)
    return _rounded(validate_imputation(df, filled), "min_before", "max_before", "min_after", "max_after")


@query(
    EVENTS_N_CTE
    + """, filled AS (SELECT *, CASE WHEN value_n IS NULL THEN 0 ELSE value_n END AS value_f,
  CASE WHEN type_n IS NULL AND event_id % 2 = 0 THEN 'x' ELSE type_n END AS type_f FROM events_n),
n AS (SELECT count(*) - count(value_n) AS v0, count(*) - count(value_f) AS v1, count(*) - count(type_n) AS t0, count(*) - count(type_f) AS t1,
  coalesce(min(value_f) < min(value_n) OR max(value_f) > max(value_n), false) AS beyond FROM filled)
SELECT CAST(v0 + t0 AS BIGINT) AS total_missing_before, CAST(v1 + t1 AS BIGINT) AS total_missing_after,
  CAST(v0 + t0 - v1 - t1 AS BIGINT) AS missing_reduction,
  'value_n' AS columns_fully_imputed, 'type_n' AS columns_partially_imputed, CASE WHEN beyond THEN 'value_n' ELSE '' END AS columns_outside_range
FROM n"""
)
def impute_totals(spark, sf_dir):
    """Totals of an imputation that fills one column fully and one in part."""
    df = events_n(spark, sf_dir).select("event_id", "value_n", "type_n")
    half = F.when(F.col("type_n").isNull() & (F.col("event_id") % 2 == 0), "x").otherwise(F.col("type_n"))
    filled = impute.fit(df, {"value_n": Strategy.CONSTANT}).transform(df).withColumn("type_n", half)
    found = imputation_totals(df, filled)
    lists = ("columns_fully_imputed", "columns_partially_imputed", "columns_outside_range")
    return found.withColumns({c: F.array_join(c, ",") for c in lists})


def _report_sql(column: str, strategy: str, value: str, after: str = "0") -> str:
    return f"""
SELECT '{column}' AS "column", count(*) - count({column}) AS missing_before,
  printf('%.1f%%', 100.0 * (count(*) - count({column})) / count(*)) AS missing_pct_text,
  CAST({after} AS BIGINT) AS missing_after, '{strategy}' AS strategy, {value} AS value, true AS success FROM events_n"""


@query(EVENTS_N_CTE + " UNION ALL ".join([
    _report_sql("value_n", "median", "CAST(median(value_n) AS VARCHAR)"),
    _report_sql("user_n", "median", "CAST(CAST(median(user_n) AS DOUBLE) AS VARCHAR)"),
    _report_sql("type_n", "mode", _mode("type_n")),
    _report_sql("ts_n", "forward_fill", "'forward_fill'", "(SELECT count(*) FROM events_n WHERE ts_n IS NULL AND "
                "event_id < (SELECT min(event_id) FROM events_n WHERE ts_n IS NOT NULL))"),
    _report_sql("sparse_n", "median", "CAST(median(sparse_n) AS VARCHAR)"),
    _report_sql("yesno_n", "mode", _mode("yesno_n"))]))
def impute_report(spark, sf_dir):
    df = events_n(spark, sf_dir)
    fitted = impute.fit_all(df, order_by=["event_id"])
    report = fitted.report(spark, fitted.transform(df))
    return report.select("column", "missing_before", "missing_pct_text", "missing_after", "strategy", "value", "success")


@query(EVENTS_N_CTE + """
SELECT event_id, coalesce(nullif(CASE WHEN event_id % 4 = 1 THEN '' ELSE type_n END, ''), 'N/A') AS type_n,
  coalesce(user_n, 0) AS user_n, coalesce(value_n, 0) AS value_n FROM events_n
""")
def clean_answer(spark, sf_dir):
    """Missing and empty cells of an answer table (M7)."""
    df = events_n(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 4 == 1, "").otherwise(F.col("type_n")).alias("type_n"), "user_n", "value_n"
    )
    return impute.clean_result(df)


# Orders that are cut into many buckets, whatever the size of the tables.

ORDER_TEXT = "concat('ORDER-2024-', CAST(1000000000 + event_id * 7919 % 1000003 AS VARCHAR(20)))"


def _text_order(spark, sf_dir):
    df = events_n(spark, sf_dir).withColumn("ref", F.expr(ORDER_TEXT.replace("VARCHAR(20)", "STRING")))
    return df.select("event_id", "ref", "value_n", "type_n", "sparse_n")


@query(EVENTS_N_CTE + f"""
SELECT event_id, last_value(value_n IGNORE NULLS) OVER (ORDER BY {ORDER_TEXT}, event_id) AS value_n,
  last_value(type_n IGNORE NULLS) OVER (ORDER BY {ORDER_TEXT}, event_id) AS type_n FROM events_n
""")
def ffill_text_order(spark, sf_dir):
    """Texts with a common head, cut into buckets of 500 rows."""
    df = _text_order(spark, sf_dir)
    fills = {"value_n": "forward_fill", "type_n": "forward_fill"}
    return ordered.fill_ordered(df, fills, ["ref", "event_id"], rows_per_bucket=500).drop("ref", "sparse_n")


@query(EVENTS_N_CTE + f""", placed AS (
  SELECT event_id, sparse_n, row_number() OVER (ORDER BY {ORDER_TEXT}, event_id) AS p FROM events_n),
around AS (
  SELECT *, last_value(CASE WHEN sparse_n IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p) AS p0,
    last_value(sparse_n IGNORE NULLS) OVER (ORDER BY p) AS v0,
    first_value(CASE WHEN sparse_n IS NOT NULL THEN p END IGNORE NULLS)
      OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
    first_value(sparse_n IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM placed)
SELECT event_id, round(CASE WHEN sparse_n IS NOT NULL THEN sparse_n WHEN p0 IS NULL THEN NULL WHEN p1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 4) AS sparse_n FROM around
""")
def interpolate_text_order(spark, sf_dir):
    df = _text_order(spark, sf_dir).select("event_id", "ref", "sparse_n")
    filled = ordered.fill_ordered(df, {"sparse_n": "interpolate"}, ["ref", "event_id"], rows_per_bucket=500)
    return _rounded(filled.drop("ref"), "sparse_n")


HEAVY = "CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 3 = 1 THEN 9 ELSE event_id % 12 END"


@query(EVENTS_N_CTE + f"""
SELECT event_id, first_value(sparse_n IGNORE NULLS) OVER (ORDER BY {HEAVY}, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sparse_n FROM events_n
""")
def bfill_two_heavy(spark, sf_dir):
    """Two order values hold a third of the rows each."""
    df = events_n(spark, sf_dir).select("event_id", "sparse_n", F.expr(HEAVY).alias("day"))
    filled = ordered.fill_ordered(df, {"sparse_n": "backward_fill"}, ["day", "event_id"], rows_per_bucket=300)
    return filled.drop("day")


@query("""
SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY 9007199254740992 + l_partkey % 50 DESC) AS rank FROM lineitem
""")
def an_ranked_big(spark, sf_dir):
    """Numbers that share a double, most of them many times."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("9007199254740992L + l_partkey % 50").alias("big")
    )
    return ordered.rank_rows(df, "big", rows_per_bucket=700).drop("big")


@query("""
SELECT o_orderkey, rank() OVER (ORDER BY CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END NULLS LAST) AS rank
FROM orders
""")
def an_ranked_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END").alias("day")
    )
    return ordered.rank_rows(df, "day", descending=False, rows_per_bucket=100).drop("day")


@query(EVENTS_N_CTE + """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS quantity, coalesce(yesno_n, 'No') AS yesno_n FROM events_n
""")
def fill_boolean_default(spark, sf_dir):
    """A number column with 0 and 1 among its values is no flag unless it is named."""
    df = events_n(spark, sf_dir).selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS quantity", "yesno_n")
    return impute.fill_boolean(df)


@query(EVENTS_N_CTE + """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'hello' ELSE '2024-01-05' END AS note,
  last_value(CASE WHEN event_id % 6 <> 0 THEN '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' END IGNORE NULLS)
    OVER (ORDER BY event_id) AS day FROM events_n
""")
def datetime_mixed_text(spark, sf_dir):
    """Texts beside dates stay as they are; only a column of dates is filled (M4)."""
    df = events_n(spark, sf_dir).selectExpr(
        "event_id", "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'hello' ELSE '2024-01-05' END AS note",
        "CASE WHEN event_id % 6 <> 0 THEN concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0')) END AS day",
    )
    filled = impute.fill_datetime(df, ["event_id"])
    return filled.withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))
