"""Declared questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators.analyze import ASCENDING, DESCENDING, AnalysisSpec, Metric, answer, popular
from dqspark.operators.columns import map_to_rows
from dqspark.operators.flags import flag_rows
from dqspark.operators.rules import negative
from dqspark.plans.answers import ask
from dqspark.queries.registry import EVENTS_N_CTE, events_n, query, table

COUNT = Metric("n", "count")


def _round(df, *names):
    return df.withColumns({c: F.round(c, 4) for c in names})


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def an_count(spark, sf_dir):
    """How many orders per priority?"""
    return ask(table(spark, sf_dir, "orders"), AnalysisSpec([COUNT], ["o_orderpriority"]))


@query("""
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_quantity), 4) AS avg_qty
FROM lineitem GROUP BY 1, 2
""")
def an_avg(spark, sf_dir):
    spec = AnalysisSpec(
        [Metric("avg_price", "avg", "l_extendedprice"), Metric("avg_qty", "avg", "l_quantity")],
        ["l_returnflag", "l_linestatus"],
    )
    return _round(answer(table(spark, sf_dir, "lineitem"), spec), "avg_price", "avg_qty")


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1")
def an_sum(spark, sf_dir):
    """Which suppliers have the highest revenue?"""
    spec = AnalysisSpec([Metric("revenue", "sum", "l_extendedprice")], ["l_suppkey"])
    found = ask(table(spark, sf_dir, "lineitem"), spec, "Which suppliers have the highest revenue?")
    return found.withColumn("revenue", F.round("revenue", 2))


@query("""
SELECT event_type, min(value) AS low, max(value) AS high, arg_min(event_id, ts) AS first_event,
  arg_max(event_id, ts) AS last_event, count(DISTINCT user_id) AS n_users
FROM events GROUP BY 1
""")
def an_minmax(spark, sf_dir):
    spec = AnalysisSpec(
        [Metric("low", "min", "value"), Metric("high", "max", "value"),
         Metric("first_event", "first_at", "event_id", by="ts"), Metric("last_event", "last_at", "event_id", by="ts"),
         Metric("n_users", "distinct", "user_id")],
        ["event_type"],
    )
    return answer(table(spark, sf_dir, "events"), spec)


@query("""
SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS finished_pct
FROM orders GROUP BY 1
""")
def an_rate(spark, sf_dir):
    """Share of finished orders per priority; the status column of the flags takes no part."""
    flagged = flag_rows(table(spark, sf_dir, "orders"), [negative("o_totalprice")]).data
    spec = AnalysisSpec([Metric("finished_pct", "rate", condition="o_orderstatus = 'F'")], ["o_orderpriority"], order=DESCENDING)
    return answer(flagged, spec)


@query("SELECT strftime(o_orderdate, '%B') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def an_month(spark, sf_dir):
    """Months in words, all years together."""
    spec = AnalysisSpec([COUNT, Metric("total", "sum", "o_totalprice")], time_column="o_orderdate", time_bucket="month")
    return ask(table(spark, sf_dir, "orders"), spec, "How many orders per month?").withColumn("total", F.round("total", 2))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
""")
def an_yearmonth(spark, sf_dir):
    """A question that names a year is answered by year and month."""
    where = "o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'"
    spec = AnalysisSpec([COUNT], time_column="o_orderdate", time_bucket="month", where=where)
    return ask(table(spark, sf_dir, "orders"), spec, "Orders per month in 1996?")


@query("SELECT dayname(l_shipdate) AS weekday, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY 1")
def an_weekday(spark, sf_dir):
    spec = AnalysisSpec([COUNT, Metric("avg_qty", "avg", "l_quantity")], time_column="l_shipdate", time_bucket="weekday")
    return _round(answer(table(spark, sf_dir, "lineitem"), spec), "avg_qty")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS top FROM orders GROUP BY 1")
def an_year(spark, sf_dir):
    spec = AnalysisSpec([Metric("top", "max", "o_totalprice")], time_column="o_orderdate", time_bucket="year")
    return answer(table(spark, sf_dir, "orders"), spec)


@query("""
SELECT CAST(isoyear(l_shipdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(l_shipdate) AS VARCHAR), 2, '0') AS week,
  count(*) AS n FROM lineitem GROUP BY 1
""")
def an_week(spark, sf_dir):
    spec = AnalysisSpec([COUNT], time_column="l_shipdate", time_bucket="week")
    return answer(table(spark, sf_dir, "lineitem"), spec)


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS period_start, count(*) AS n FROM events GROUP BY 1, 2")
def an_span(spark, sf_dir):
    """Fixed spans of time."""
    spec = AnalysisSpec([COUNT], ["event_type"], "ts", "6 hours")
    return answer(table(spark, sf_dir, "events"), spec)


@query("""
SELECT p_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rank, rank = 1 AS is_top FROM part GROUP BY 1
""")
def an_popular(spark, sf_dir):
    return popular(table(spark, sf_dir, "part"), "p_type")


@query("""
SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY count(*)) AS rank, rank = 1 AS is_top FROM part GROUP BY 1
""")
def an_unpopular(spark, sf_dir):
    return popular(table(spark, sf_dir, "part"), "p_brand", most=False)


@query("""
SELECT l_partkey, sum(l_quantity) AS qty, rank() OVER (ORDER BY sum(l_quantity) DESC) AS rank, rank = 1 AS is_top
FROM lineitem GROUP BY 1
""")
def an_ranked(spark, sf_dir):
    """The whole table of groups, each with its rank."""
    spec = AnalysisSpec([Metric("qty", "sum", "l_quantity")], ["l_partkey"], order=DESCENDING, ranked=True)
    return answer(table(spark, sf_dir, "lineitem"), spec)


@query("SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 ORDER BY qty, l_suppkey LIMIT 20")
def an_lowest(spark, sf_dir):
    """The twenty suppliers with the lowest quantity (K1, K2)."""
    spec = AnalysisSpec([Metric("qty", "sum", "l_quantity")], ["l_suppkey"], order=ASCENDING, limit=20)
    return answer(table(spark, sf_dir, "lineitem"), spec)


@query(EVENTS_N_CTE + """
SELECT coalesce(type_n, 'N/A') AS type_n, round(coalesce(avg(sparse_n), 0), 4) AS avg_value, count(*) AS n
FROM events_n WHERE sparse_n IS NULL OR type_n = 'view' GROUP BY type_n
""")
def an_clean(spark, sf_dir):
    """Missing group and missing average in a rectangular answer."""
    spec = AnalysisSpec(
        [Metric("avg_value", "avg", "sparse_n"), COUNT], ["type_n"], where="sparse_n IS NULL OR type_n = 'view'"
    )
    return _round(ask(events_n(spark, sf_dir), spec), "avg_value")


@query("SELECT event_type AS Key, round(sum(value), 2) AS Value FROM events GROUP BY 1")
def an_map_rows(spark, sf_dir):
    """A map of results as a two-column table."""
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    return map_to_rows(sums.select(F.create_map("event_type", "v").alias("m")), "m")


@query("""
SELECT CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
  WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October'
  WHEN 11 THEN 'November' ELSE 'December' END AS month, count(*) AS n FROM orders GROUP BY 1
""")
def an_month_number(spark, sf_dir):
    """A number column of months, answered by name."""
    orders = table(spark, sf_dir, "orders").selectExpr("month(o_orderdate) AS m")
    return answer(orders, AnalysisSpec([Metric("n", "count")], time_column="m", time_bucket="month"))
