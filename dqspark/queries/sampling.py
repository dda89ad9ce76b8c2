"""Stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import sample
from dqspark.operators.columns import missing_count
from dqspark.operators.profile import mostly_missing_rows as rows_with_gaps
from dqspark.queries.registry import (
    BOOKINGS_CTE,
    EVENTS_N_CTE,
    bookings,
    duck_unusual,
    events_n,
    query,
)


def sample_sql(source: str, key: str, strata: list[tuple[int, str, str, int, str]], columns: str) -> str:
    """Strata as (group 0-2, reason, condition, cap, seed or ''); 45 / 60 / 45 of 150 rows."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, {group} AS grp, {i} AS stratum, '{reason}' AS reason, row_number() OVER (ORDER BY "
        + (f"md5('{seed}:' || {key}), " if seed else "")
        + f"{key}) AS pos, {cap} AS cap FROM {source} WHERE {condition}"
        for i, (group, reason, condition, cap, seed) in enumerate(strata)
    )
    return f"""
, c AS (SELECT * FROM ({parts}) WHERE pos <= cap)
, per_group AS (SELECT {key}, grp, min((stratum, pos)) AS place, arg_min(reason, (stratum, pos)) AS reason FROM c GROUP BY 1, 2)
, kept AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place, {key}) AS n FROM per_group)
, once AS (SELECT {key}, min((grp, place)) AS rank, arg_min(reason, (grp, place)) AS reason FROM kept
  WHERE n <= CASE grp WHEN 0 THEN 45 WHEN 1 THEN 60 ELSE 150 END GROUP BY 1)
, chosen AS (SELECT {key}, reason FROM once ORDER BY rank, {key} LIMIT 150)
SELECT {columns}, reason FROM {source} JOIN chosen USING ({key})"""


def _fences(source: str, column: str) -> str:
    q1, q3 = (f"(SELECT quantile_cont({column}, {p}) FROM {source})" for p in (0.25, 0.75))
    return f"({column} < {q1} - 1.5 * ({q3} - {q1}) OR {column} > {q3} + 1.5 * ({q3} - {q1}))"


EVENT_NUMBERS = ["event_id", "user_id", "value_n", "user_n", "sparse_n", "fare"]
EVENT_GAPS = " + ".join(f"({c} IS NULL)::INT" for c in ("value_n", "user_n", "type_n", "ts_n", "sparse_n", "yesno_n"))
RANDOM = [(0, "random", "true", 45, "42")]
EVENT_ISSUES = [
    (1, "high_missing", f"{EVENT_GAPS} > 11 * 0.2", 30, ""),
    *[(1, f"outlier:{c}", _fences("events_n", c), 15, "") for c in EVENT_NUMBERS],
    (1, "top_up", "true", 60, "43"),
]
EVENT_CONTRADICTIONS = [
    (2, "negative:fare", "fare < 0", 10, ""),
    (2, "extreme:fare", "fare > 10 * (SELECT quantile_cont(fare, 0.75) FROM events_n)", 5, ""),
    *[(2, f"unusual:{c}", duck_unusual(c), 45, "") for c in ("event_type", "type_n", "yesno_n")],
]


@query(EVENTS_N_CTE + sample_sql("events_n", "event_id", RANDOM + EVENT_ISSUES + EVENT_CONTRADICTIONS,
                                 "event_id, user_id, type_n"))
def sample_stratified(spark, sf_dir):
    found = sample.take_sample(events_n(spark, sf_dir), ["event_id"])
    return found.select("event_id", "user_id", "type_n", "reason")


@query(EVENTS_N_CTE + sample_sql("events_n", "event_id", EVENT_ISSUES, "event_id, value_n"))
def sample_issues(spark, sf_dir):
    found = sample.take_sample(events_n(spark, sf_dir), ["event_id"], groups=[sample.ISSUE])
    return found.select("event_id", "value_n", "reason")


BOTH = "trim(window_seat) IN ({0}) AND trim(aisle_seat) IN ({0})"
BOOKING_TEXTS = ["priority", "window_seat", "aisle_seat", "booking_status", "layovers", "layover_locations", "gate", "loc"]
BOOKING_CONTRADICTIONS = [
    (2, "both:window_seat+aisle_seat", BOTH.format("'Window', 'Aisle'"), 45, ""),
    (2, "both:window_seat+aisle_seat", BOTH.format("'true', 'True', 'Y', 'Yes', '1'"), 45, ""),
    (2, "terms:booking_status", "contains(lower(booking_status), 'cancelled') AND contains(lower(booking_status), "
     "'confirmed')", 45, ""),
    *[
        stratum
        for c in ("total_fare", "base_fare", "tax_fare")
        for stratum in (
            (2, f"negative:{c}", f"{c} < 0", 10, ""),
            (2, f"extreme:{c}", f"{c} > 10 * (SELECT quantile_cont({c}, 0.75) FROM bookings)", 5, ""),
        )
    ],
    *[(2, f"unusual:{c}", duck_unusual(c), 45, "") for c in BOOKING_TEXTS],
]


@query(BOOKINGS_CTE + sample_sql("bookings", "booking_id", BOOKING_CONTRADICTIONS, "booking_id, booking_status"))
def sample_contradictions(spark, sf_dir):
    found = sample.take_sample(bookings(spark, sf_dir), ["booking_id"], groups=[sample.CONTRADICTION])
    return found.select("booking_id", "booking_status", "reason")


@query(EVENTS_N_CTE + sample_sql("events_n", "event_id", RANDOM, "event_id").replace(
    "SELECT event_id, reason FROM events_n JOIN chosen USING (event_id)",
    "SELECT 'smart_sampling' AS sampling_strategy, (SELECT count(*) FROM events_n) AS original_rows, "
    "count(*) AS sampled_rows, round(count(*) / (SELECT count(*) FROM events_n), 6) AS sampling_ratio FROM chosen"))
def sample_info(spark, sf_dir):
    df = events_n(spark, sf_dir)
    found = sample.sample_info(df, sample.take_sample(df, ["event_id"], groups=[sample.RANDOM]))
    return found.withColumn("sampling_ratio", F.round("sampling_ratio", 6))


@query(EVENTS_N_CTE + f"SELECT event_id, CAST({EVENT_GAPS} AS INTEGER) AS n_missing FROM events_n WHERE {EVENT_GAPS} > 11 * 0.2")
def mostly_missing_rows(spark, sf_dir):
    df = events_n(spark, sf_dir)
    return rows_with_gaps(df).select("event_id", missing_count(df).alias("n_missing"))
