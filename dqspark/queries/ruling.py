"""Detection rules, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import rules, stats
from dqspark.operators.columns import rename
from dqspark.operators.flags import flag_rows
from dqspark.queries.registry import (
    BOOKINGS_CTE,
    EVENTS_N_CTE,
    bookings,
    duck_items,
    duck_trim,
    duck_unusual,
    events_n,
    query,
    table,
)

TRUE_SQL = "('true', 't', 'yes', 'y', '1')"


def _found(df, rule, *columns):
    return df.where(F.expr(rule.detection_code)).select(*columns)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def rule_negative(spark, sf_dir):
    return _found(table(spark, sf_dir, "customer"), rules.negative("c_acctbal"), "c_custkey", "c_acctbal")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate
""")
def rule_date_order(spark, sf_dir):
    """Lines shipped before their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    rule = rules.starts_after_end("o_orderdate", "l_shipdate")
    return _found(joined, rule, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "l_shipdate")


@query(BOOKINGS_CTE + f"""
SELECT booking_id, layovers, layover_locations FROM bookings
WHERE coalesce(try_cast(layovers AS BIGINT), 0) <> {duck_items('layover_locations')}
""")
def rule_count_list(spark, sf_dir):
    rule = rules.count_mismatch("layovers", "layover_locations")
    return _found(bookings(spark, sf_dir), rule, "booking_id", "layovers", "layover_locations")


@query(BOOKINGS_CTE + f"""
SELECT booking_id, n_layovers, layover_locations
FROM (SELECT booking_id, CAST(layovers AS INTEGER) AS n_layovers, layover_locations FROM bookings)
WHERE coalesce(n_layovers, 0) <> {duck_items('layover_locations')}
""")
def rule_pairs_by_name(spark, sf_dir):
    """The pair is found by the stem both names share."""
    df = bookings(spark, sf_dir).select(
        "booking_id", F.col("layovers").cast("int").alias("n_layovers"), "layover_locations", "priority"
    )
    named = rename(df, {"n_layovers": "layovers"})
    ((count, items),) = rules.count_list_pairs(named)
    found = _found(named, rules.count_mismatch(count, items), "booking_id", count, items)
    return found.withColumnRenamed(count, "n_layovers")


@query(BOOKINGS_CTE + f"""
SELECT booking_id, layover_locations FROM bookings
WHERE layover_locations IS NULL OR {duck_trim('layover_locations')} = ''
""")
def rule_blank(spark, sf_dir):
    return _found(bookings(spark, sf_dir), rules.blank("layover_locations"), "booking_id", "layover_locations")


@query(BOOKINGS_CTE + f"""
SELECT booking_id FROM bookings
WHERE lower(trim(window_seat)) IN {TRUE_SQL} AND lower(trim(aisle_seat)) IN {TRUE_SQL}
""")
def rule_bool_conflict(spark, sf_dir):
    return _found(bookings(spark, sf_dir), rules.both_true("window_seat", "aisle_seat"), "booking_id")


@query(BOOKINGS_CTE + """
SELECT booking_id FROM bookings WHERE trim(window_seat) IN ('true', 'True', 'Y', 'Yes', '1')
  AND trim(aisle_seat) IN ('true', 'True', 'Y', 'Yes', '1')
""")
def rule_exclusive_options(spark, sf_dir):
    """Columns found by name, texts as the list has them."""
    df = bookings(spark, sf_dir)
    named = [r for r in rules.rules_from_names(df) if r.columns == ("window_seat", "aisle_seat")]
    return df.where(F.expr(" OR ".join(f"({r.detection_code})" for r in named))).select("booking_id")


@query(BOOKINGS_CTE + """
SELECT booking_id, booking_status FROM bookings
WHERE contains(lower(booking_status), 'cancelled') AND contains(lower(booking_status), 'confirmed')
""")
def rule_status_terms(spark, sf_dir):
    df = bookings(spark, sf_dir)
    rule = next(r for r in rules.rules_from_names(df) if r.columns == ("booking_status",))
    return _found(df, rule, "booking_id", "booking_status")


@query(EVENTS_N_CTE + """
SELECT event_id, round(fare, 4) AS fare FROM events_n WHERE fare > 10 * (SELECT quantile_cont(fare, 0.75) FROM events_n)
""")
def rule_extreme(spark, sf_dir):
    df = events_n(spark, sf_dir)
    ((q3,),) = stats.quantiles(df, {"fare": [0.75]}).values()
    return _found(df, rules.above("fare", 10 * q3), "event_id", F.round("fare", 4).alias("fare"))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
""")
def rule_iqr(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    (rule,) = rules.rules_from_values(df, ["value"])
    return _found(df, rule, "event_id", "value")


@query(f"SELECT doc_id, lang FROM documents WHERE {duck_unusual('text')}")
def rule_unusual_text(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), rules.unusual_text("text"), "doc_id", "lang")


@query(EVENTS_N_CTE + """
SELECT event_id FROM events_n WHERE (value_n IS NULL)::INT + (user_n IS NULL)::INT + (type_n IS NULL)::INT
  + (ts_n IS NULL)::INT + (sparse_n IS NULL)::INT + (yesno_n IS NULL)::INT > 11 * 0.2
""")
def rule_missing_row(spark, sf_dir):
    df = events_n(spark, sf_dir)
    return _found(df, rules.mostly_missing(df.columns), "event_id")


@query(BOOKINGS_CTE + """
SELECT booking_id, payment_date FROM bookings WHERE lower(trim(booking_status)) = 'cancelled' AND payment_date IS NOT NULL
""")
def rule_status_field(spark, sf_dir):
    rule = rules.status_conflict("booking_status", "Cancelled", "payment_date")
    return _found(bookings(spark, sf_dir), rule, "booking_id", "payment_date")


TRIPS = """
SELECT booking_id, start_date, start_date + INTERVAL '1' HOUR * CAST(booking_id % 10 AS INT) AS end_date,
  CAST(booking_id % 10 + CASE WHEN booking_id % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS duration_hours
FROM {bookings}
"""


@query(BOOKINGS_CTE + f"""
, trips AS ({TRIPS.format(bookings='bookings')})
SELECT booking_id, duration_hours FROM trips
WHERE abs((epoch_us(end_date) - epoch_us(start_date)) / 3.6e9 - duration_hours) > 0.01
""")
def rule_duration(spark, sf_dir):
    trips = spark.sql(TRIPS, bookings=bookings(spark, sf_dir))
    rule = rules.duration_mismatch("start_date", "end_date", "duration_hours", seconds_per_unit=3600, tolerance=0.01)
    return _found(trips, rule, "booking_id", "duration_hours")


@query(BOOKINGS_CTE + """
SELECT booking_id, total_fare, base_fare, tax_fare FROM bookings WHERE abs(total_fare - (base_fare + tax_fare)) > 0.5
""")
def rule_total(spark, sf_dir):
    rule = rules.total_mismatch("total_fare", ["base_fare", "tax_fare"], 0.5)
    return _found(bookings(spark, sf_dir), rule, "booking_id", "total_fare", "base_fare", "tax_fare")


LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
  round(l_extendedprice / l_quantity, 2) + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS unit_price,
  l_extendedprice * l_discount AS rebate,
  round(100 * l_discount, 0) + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS rebate_pct
FROM {lineitem}
"""


@query(f"""
WITH lines AS ({LINES.format(lineitem='lineitem')})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(abs(unit_price - l_extendedprice / nullif(l_quantity, 0)) > 0.5, false) AS bad_average,
  coalesce(abs(rebate_pct - 100 * rebate / nullif(l_extendedprice, 0)) > 0.5, false) AS bad_percentage
FROM lines WHERE bad_average OR bad_percentage
""")
def rule_average_percentage(spark, sf_dir):
    lines = spark.sql(LINES, lineitem=table(spark, sf_dir, "lineitem"))
    tests = {
        "bad_average": rules.average_mismatch("unit_price", "l_extendedprice", "l_quantity", 0.5),
        "bad_percentage": rules.percentage_mismatch("rebate_pct", "rebate", "l_extendedprice", 0.5),
    }
    marked = lines.withColumns({n: F.coalesce(F.expr(r.detection_code), F.lit(False)) for n, r in tests.items()})
    found = marked.where("bad_average OR bad_percentage")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *tests)


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS lines_sum FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, round(lines_sum, 2) AS lines_sum,
  coalesce(abs(o_totalprice - coalesce(lines_sum, 0)) > 5000, false) AS total_mismatch
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
""")
def rule_total_across(spark, sf_dir):
    """Order totals against the sum of their lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    found = rules.cross_table_totals(orders, lines, "o_orderkey", "l_orderkey", "o_totalprice", "l_extendedprice", 5000)
    return found.withColumn("lines_sum", F.round("lines_sum", 2))


@query("""
WITH s AS (SELECT event_id, props,
  regexp_replace(regexp_replace(props, '\\p{L}', 'A', 'g'), '\\p{Nd}', '9', 'g') AS shape FROM events)
SELECT event_id, props FROM s
WHERE shape NOT IN (SELECT shape FROM s GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT count(*) FROM s))
""")
def rule_format(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rule = rules.rare_format("props", rules.common_shapes(events, "props", 0.2))
    return _found(events, rule, "event_id", "props")


PRICES = """o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice WHEN o_orderkey % 77 = 0 THEN o_totalprice * 40
  ELSE o_totalprice END AS ticket_price"""


@query(f"""
WITH p AS (SELECT {PRICES} FROM orders)
SELECT o_orderkey, ticket_price FROM p
WHERE ticket_price < 0 OR ticket_price > 10 * (SELECT quantile_cont(ticket_price, 0.75) FROM p)
""")
def rule_price_names(spark, sf_dir):
    """Rules that the name ``price`` and the values call for, and the rows they find."""
    orders = spark.sql(f"SELECT {PRICES} FROM {{orders}}", orders=table(spark, sf_dir, "orders"))
    named = [r for r in rules.rules_from_names(orders) if "ticket_price" in r.columns]
    named += [r for r in rules.rules_from_values(orders, ["ticket_price"]) if "extremely" in r.explanation]
    return orders.where(F.expr(" OR ".join(f"({r.detection_code})" for r in named)))


MIXED = """event_id, value, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 10 AS VARCHAR(5)) END AS txt,
  event_id % 4 AS zero_n"""


@query(f"""
WITH m AS (SELECT {MIXED} FROM events)
SELECT event_id, CAST(CASE WHEN try_cast(txt AS INTEGER) > 5 THEN 1 ELSE 0 END
  + CASE WHEN zero_n <> 0 AND 1.0 / zero_n > 0.4 THEN 2 ELSE 0 END + CASE WHEN value > 20 THEN 4 ELSE 0 END AS BIGINT) AS flag_status
FROM m
""")
def rule_runtime_errors(spark, sf_dir):
    """Rules that cannot be computed on some rows leave those, and the other rules, alone."""
    events = spark.sql(f"SELECT {MIXED} FROM {{events}}", events=table(spark, sf_dir, "events"))
    listed = [
        rules.Rule("txt > 5", ("txt",), "text above five"),
        rules.Rule("1.0 / zero_n > 0.4", ("zero_n",), "large part"),
        rules.Rule("value > 20", ("value",), "large value"),
    ]
    return flag_rows(events, listed).data.select("event_id", "flag_status")


GAPS = "event_id, CASE WHEN event_id % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 4 = 1 THEN NULL ELSE value END AS v"


@query(f"""
WITH g AS (SELECT {GAPS} FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 4 < 2 THEN 1 WHEN v > 20 THEN 2 ELSE 0 END
  + CASE WHEN event_id % 4 >= 2 AND (v < 1 OR v > 30) THEN 4 ELSE 0 END + CASE WHEN event_id % 4 < 2 THEN 8 ELSE 0 END AS BIGINT) AS flag_status
FROM g
""")
def rules_nan(spark, sf_dir):
    """NaN is missing: never large, always blank."""
    gaps = spark.sql(f"SELECT {GAPS} FROM {{events}}", events=table(spark, sf_dir, "events"))
    listed = [rules.blank("v"), rules.above("v", 20), rules.outside("v", 1, 30), rules.mostly_missing(["event_id", "v"])]
    return flag_rows(gaps, listed).data.select("event_id", "flag_status")
