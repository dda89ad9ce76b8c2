"""Registry, table access and the dirty views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under a name, else that of its function, with its SQL."""

    def register(function):
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLE[name or function.__name__] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The test tables hold no missing and hardly any dirty values; these views add
# them.  The text runs in both engines; {events} and {orders} stand for tables.
EVENTS_N = """
SELECT event_id, user_id, ts, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_n,
  CASE WHEN event_id % 11 = 3 THEN NULL ELSE event_type END AS type_n,
  CASE WHEN event_id % 13 = 5 THEN NULL ELSE ts END AS ts_n,
  CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS sparse_n,
  CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 4 THEN NULL ELSE 'No' END AS yesno_n,
  value * CASE WHEN event_id % 500 = 0 THEN 100 ELSE 1 END AS fare
FROM {events}
"""

BOOKINGS = """
SELECT o_orderkey AS booking_id, o_orderdate AS start_date, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS cust_n,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE ' no ' END AS window_seat,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' ELSE 'N' END AS aisle_seat,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Cancelled/Confirmed' WHEN o_orderkey % 10 = 1 THEN 'Cancelled'
       ELSE 'Confirmed' END AS booking_status,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE NULL END AS payment_date,
  CAST(o_orderkey % 4 AS VARCHAR(5)) AS layovers,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'JFK' WHEN 2 THEN 'JFK->LHR' WHEN 3 THEN 'JFK; LHR, CDG'
       WHEN 4 THEN 'JFK|LHR' ELSE '  ' END AS layover_locations,
  o_totalprice AS total_fare, round(o_totalprice * 0.8, 2) AS base_fare,
  round(o_totalprice - round(o_totalprice * 0.8, 2) + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END, 2) AS tax_fare,
  concat('Gate', CASE WHEN o_orderkey % 2 = 0 THEN 'zn' ELSE 'qa' END) AS gate,
  CASE WHEN o_orderkey % 25 = 0 THEN 'x9' ELSE concat('Loc_', CAST(o_orderkey % 50 AS VARCHAR(5))) END AS loc
FROM {orders}
"""

EVENTS_N_CTE = "WITH events_n AS (" + EVENTS_N.format(events="events") + ")"
BOOKINGS_CTE = "WITH bookings AS (" + BOOKINGS.format(orders="orders") + ")"


def events_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_N, events=table(spark, sf_dir, "events"))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOOKINGS, orders=table(spark, sf_dir, "orders"))


# --- pieces of SQL ----------------------------------------------------------

DUCK_SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def duck_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{DUCK_SPACE}|{DUCK_SPACE}$', '', 'g')"


def duck_clean(c: str) -> str:
    return f"regexp_replace({duck_trim(c)}, '{DUCK_SPACE}', ' ', 'g')"


def duck_title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        f"lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def duck_unusual(c: str) -> str:
    return (
        f"((length({c}) > 1 AND {c} <> upper({c}) AND {c} <> lower({c}) AND {c} <> {duck_title(c)}) "
        f"OR contains({c}, '  ') OR regexp_matches({c}, '[@#$%&*]'))"
    )


def duck_items(c: str) -> str:
    return (
        f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[;,|>]|->'), lambda x: trim(x) <> ''))"
    )
