"""Flags (R18, A15-A21, F16-F19, F26, F27, P1-P5, P10, X1-X4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.flagbits import binary_text
from dqspark.operators import flags, issues, rules
from dqspark.operators.columns import friendly_names, full_renames, rename, valid_renames
from dqspark.operators.flags import flag_rows as flag_all
from dqspark.plans.quality import check
from dqspark.queries.registry import BOOKINGS_CTE, bookings, duck_items, query, table

YES = "('true', 't', 'yes', 'y', '1')"
# flag -> (rule, the same test in SQL, explanation, category, severity)
BOOKING_RULES = [
    (rules.both_true("window_seat", "aisle_seat"),
     f"lower(trim(window_seat)) IN {YES} AND lower(trim(aisle_seat)) IN {YES}"),
    (rules.count_mismatch("layovers", "layover_locations"),
     f"coalesce(try_cast(layovers AS BIGINT), 0) <> {duck_items('layover_locations')}"),
    (rules.blank("layover_locations"), "layover_locations IS NULL OR trim(layover_locations) = ''"),
    (rules.conflicting_terms("booking_status", ("cancelled", "confirmed")),
     "contains(lower(booking_status), 'cancelled') AND contains(lower(booking_status), 'confirmed')"),
    (rules.status_conflict("booking_status", "cancelled", "payment_date"),
     "lower(trim(booking_status)) = 'cancelled' AND payment_date IS NOT NULL"),
    (rules.total_mismatch("total_fare", ["base_fare", "tax_fare"], 0.5),
     "abs(total_fare - (base_fare + tax_fare)) > 0.5"),
    (rules.blank("cust_n"), "cust_n IS NULL"),
    (rules.Rule("priority = '1-URGENT' AND total_fare > 400000", ("priority", "total_fare"), "urgent and expensive"),
     "priority = '1-URGENT' AND total_fare > 400000"),
]
RULES = [r for r, _ in BOOKING_RULES]
MASK = " + ".join(f"CASE WHEN {sql} THEN {1 << i} ELSE 0 END" for i, (_, sql) in enumerate(BOOKING_RULES))
FLAGGED = BOOKINGS_CTE + f", flagged AS (SELECT *, CAST({MASK} AS BIGINT) AS flag_status FROM bookings)"
FLAGS = "[" + ", ".join(str(1 << i) for i in range(len(RULES))) + "]"
SET_FLAGS = f"list_filter({FLAGS}, lambda f: (flag_status & f) <> 0)"
ISSUES = ", issues AS (SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', '{}', '{}', '{}')".format(1 << i, r.explanation, r.category, r.severity, ", ".join(r.columns))
    for i, r in enumerate(RULES)
) + ") t(flag_value, description, category, severity, affected_columns))"


def _run(spark, sf_dir, used=RULES):
    return flag_all(bookings(spark, sf_dir), used)


@query(FLAGGED + "SELECT booking_id, flag_status FROM flagged")
def flag_rows(spark, sf_dir):
    """All rules in one projection."""
    return _run(spark, sf_dir).data.select("booking_id", "flag_status")


@query(FLAGGED + f"""
SELECT CAST(f AS BIGINT) AS flag_value, count(*) FILTER (WHERE (flag_status & f) <> 0) AS row_count
FROM flagged, (SELECT unnest({FLAGS}) AS f) GROUP BY 1
""")
def flag_counts(spark, sf_dir):
    return flags.flag_counts(_run(spark, sf_dir).data, [1 << i for i in range(len(RULES))])


@query(FLAGGED + f"""
SELECT flag_status, array_to_string({SET_FLAGS}, ',') AS individual_flags,
  'Flags ' || array_to_string({SET_FLAGS}, '+') AS flag_description, count(*) AS row_count,
  bin(flag_status) AS binary_representation
FROM flagged WHERE flag_status <> 0 GROUP BY flag_status
""")
def flag_combos(spark, sf_dir):
    found = flags.flag_combinations(_run(spark, sf_dir).data)
    return found.withColumn("individual_flags", F.array_join("individual_flags", ","))


@query(FLAGGED + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE flag_status <> 0) AS flagged_rows,
  count(*) FILTER (WHERE flag_status = 0) AS clean_rows,
  round(100.0 * count(*) FILTER (WHERE flag_status <> 0) / count(*), 2) AS flagged_percentage,
  CAST(sum(bit_count(flag_status)) AS BIGINT) AS total_detections, CAST(8 AS BIGINT) AS successful_codes,
  CAST(1 AS BIGINT) AS failed_codes, round(100.0 * 8 / 9, 2) AS success_rate
FROM flagged
""")
def flag_summary(spark, sf_dir):
    """One unusable rule among nine; the others still run."""
    broken = rules.Rule("no_such_function(total_fare)", ("total_fare",), "broken")
    return _run(spark, sf_dir, [*RULES, broken]).summary()


@query(FLAGGED + f"""
SELECT CAST(f AS BIGINT) AS flag_value, f <> 128 AS success,
  CASE WHEN f = 128 THEN 0 ELSE count(*) FILTER (WHERE (flag_status & f) <> 0) END AS rows_detected, f = 128 AS has_error
FROM flagged, (SELECT unnest({FLAGS}) AS f) GROUP BY f
""")
def rule_results(spark, sf_dir):
    """Rows per rule; an aggregate is not a row rule and is refused."""
    broken = rules.Rule("max(total_fare) > 1", ("total_fare",), "aggregate")
    found = _run(spark, sf_dir, [*RULES[:7], broken]).rule_results()
    return found.select("flag_value", "success", "rows_detected", F.col("error").isNotNull().alias("has_error"))


@query(BOOKINGS_CTE + f"""
SELECT booking_id, CAST(CASE WHEN coalesce(try_cast(layovers AS BIGINT), 0) <> {duck_items('layover_locations')}
  THEN 1 ELSE 0 END AS BIGINT) AS flag_status FROM bookings
""")
def rule_fallback(spark, sf_dir):
    """Two unusable rules: one has a fallback for count and list, one matches nothing."""
    used = [
        rules.Rule("size(layovers) <> 1 + ", ("layovers", "layover_locations"), "broken",
                   category="Cross-Field Relationship Validation"),
        rules.Rule("other_column > 1", ("total_fare",), "foreign column"),
    ]
    return _run(spark, sf_dir, used).data.select("booking_id", "flag_status")


@query(FLAGGED + ISSUES + f"""
SELECT booking_id, CAST(f AS BIGINT) AS flag_value, description, severity
FROM (SELECT booking_id, unnest({SET_FLAGS}) AS f FROM flagged) JOIN issues ON f = flag_value
""")
def flag_decode(spark, sf_dir):
    """One row per booking and issue."""
    table_of = flags.issues_of_rules(spark, RULES)
    found = flags.decoded(_run(spark, sf_dir).data, table_of, ["booking_id"])
    return found.select("booking_id", "flag_value", "description", "severity")


@query(FLAGGED + ISSUES + """
SELECT CAST(flag_value AS BIGINT) AS flag_value, description, category, severity, affected_columns,
  lpad(bin(CAST(flag_value AS BIGINT)), 8, '0') AS binary_representation,
  (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) AS row_count
FROM issues
""")
def flag_dim(spark, sf_dir):
    """The flag table with the rows behind each flag."""
    run = _run(spark, sf_dir)
    issue_rows = flags.with_binary(flags.issues_of_rules(spark, run.rules))
    counts = flags.flag_counts(run.data, [r.flag_value for r in run.rules])
    joined = issue_rows.join(counts, "flag_value")
    return joined.select(
        "flag_value", "description", "category", "severity", F.array_join("affected_columns", ", ").alias("affected_columns"),
        "binary_representation", "row_count",
    )


@query(FLAGGED + ISSUES + """
, used AS (SELECT * FROM issues WHERE (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) > 0)
SELECT 'severity' AS kind, severity AS name, count(*) AS n_flags FROM used GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM used GROUP BY 2
""")
def flag_distribution(spark, sf_dir):
    """Flags in use by severity and by category."""
    run = _run(spark, sf_dir)
    counts = flags.flag_counts(run.data, [r.flag_value for r in run.rules]).where("row_count > 0")
    used = flags.issues_of_rules(spark, run.rules).join(counts, "flag_value", "left_semi")
    return flags.flag_distribution(used)


@query(FLAGGED + ISSUES + """
, used AS (SELECT * FROM issues WHERE (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) > 0)
SELECT count(*) AS total_flags, CAST(max(flag_value) AS BIGINT) AS max_flag_value,
  CAST(sum(flag_value) AS BIGINT) AS max_combined_value, CAST(2 ** count(*) - 1 AS BIGINT) AS possible_combinations,
  string_agg(CAST(flag_value AS VARCHAR), ',' ORDER BY flag_value) AS flag_values FROM used
""")
def flag_totals(spark, sf_dir):
    run = _run(spark, sf_dir)
    counts = flags.flag_counts(run.data, [r.flag_value for r in run.rules]).where("row_count > 0")
    used = flags.issues_of_rules(spark, run.rules).join(counts, "flag_value", "left_semi")
    found = flags.flag_table_summary(used)
    return found.withColumns({
        "possible_combinations": F.col("possible_combinations").cast("bigint"),
        "flag_values": F.array_join("flag_values", ","),
    })


@query(FLAGGED + ISSUES + f"""
, v AS (SELECT CAST(range AS BIGINT) AS flag_status FROM range(1, 256))
, w AS (SELECT flag_status, unnest({SET_FLAGS}) AS f FROM v)
, n AS (SELECT flag_status, count(*) AS n FROM flagged GROUP BY 1)
SELECT w.flag_status AS combined, string_agg(description, ' | ' ORDER BY f) AS issues, coalesce(any_value(n), 0) AS row_count
FROM w JOIN issues ON f = flag_value LEFT JOIN n ON n.flag_status = w.flag_status GROUP BY 1
""")
def flag_possible_combinations(spark, sf_dir):
    """Every combination of the eight flags with the rows that have it."""
    run = _run(spark, sf_dir)
    listed = flags.possible_combinations(flags.issues_of_rules(spark, run.rules))
    counts = flags.flag_combinations(run.data).select(F.col("flag_status").alias("combined"), "row_count")
    joined = listed.join(counts, "combined", "left")
    return joined.select(
        "combined", F.array_join("issues", " | ").alias("issues"), F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count")
    )


@query(FLAGGED + f"""
SELECT booking_id, flag_status, 'Flags: ' || array_to_string({SET_FLAGS}, '+') AS flag_breakdown
FROM flagged WHERE flag_status > 0 ORDER BY booking_id LIMIT 10
""")
def flagged_sample(spark, sf_dir):
    found = flags.flagged_sample(_run(spark, sf_dir).data, 10, ["booking_id"])
    return found.select("booking_id", "flag_status", "flag_breakdown")


@query("""
SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS orderstatus, o_totalprice AS total,
  o_orderdate AS orderdate, o_orderpriority AS orderpriority FROM orders
""")
def rename_columns(spark, sf_dir):
    """Names without the shared prefix, one by wish, useless suggestions dropped."""
    orders = table(spark, sf_dir, "orders")
    wishes = {"o_totalprice": " total ", "o_orderkey": "Use clear names", "o_custkey": "  ", "gone": "x"}
    suggested = {**friendly_names(orders.columns), **valid_renames(wishes, orders.columns)}
    return rename(orders, full_renames(suggested, orders.columns))


@query("""
SELECT CAST(1 AS BIGINT) AS flag_value, 'total is negative' AS description, 'total' AS affected_columns,
  (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS rows_detected
UNION ALL SELECT 2, 'priority is missing or blank', 'priority',
  (SELECT count(*) FROM orders WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = '')
UNION ALL SELECT 4, 'total is extremely high', 'total', (SELECT count(*) FROM orders WHERE o_totalprice > 450000)
""")
def rename_issues(spark, sf_dir):
    """Renamed columns show up in the issues of the rules."""
    orders = table(spark, sf_dir, "orders")
    used = [rules.negative("total"), rules.blank("priority"), rules.above("total", 450000)]
    checked = check(orders, used, {"o_totalprice": "total", "o_orderpriority": "priority"})
    old = flags.issues_of_rules(
        spark, [rules.negative("o_totalprice"), rules.blank("o_orderpriority"), rules.above("o_totalprice", 450000)]
    )
    renamed = issues.rename_in_issues(old, checked.renames)
    found = checked.run.rule_results().select("flag_value", "rows_detected")
    joined = renamed.join(found, "flag_value")
    return joined.select("flag_value", "description", F.array_join("affected_columns", ", ").alias("affected_columns"), "rows_detected")


@query(FLAGGED + ISSUES + """
SELECT CAST(flag_value AS BIGINT) AS flag_value,
  array_to_string(list_transform(regexp_extract_all(category, '\\p{L}+|[^\\p{L}]+'),
    lambda w: upper(w[1]) || lower(w[2:])), '') AS category,
  upper(severity[1]) || severity[2:] AS severity,
  CASE WHEN length(description) > 100 THEN description[:100] || '...' ELSE description END AS description,
  affected_columns, 'Manual review required' AS fix_approach,
  (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) AS row_count
FROM issues
""")
def issue_table(spark, sf_dir):
    """Issues as shown to people, with their rows."""
    run = _run(spark, sf_dir)
    counts = flags.flag_counts(run.data, [r.flag_value for r in run.rules])
    return issues.shown(flags.issues_of_rules(spark, run.rules)).join(counts, "flag_value")


@query(FLAGGED + ISSUES + """
, used AS (SELECT * FROM issues WHERE (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) > 0)
SELECT count(*) AS total_issues, count(*) FILTER (WHERE severity = 'high') AS high_severity,
  count(DISTINCT category) AS n_categories, CAST(greatest(100 - 15 * count(*), 10) AS BIGINT) AS data_quality_score
FROM used
""")
def issue_metrics(spark, sf_dir):
    """Issues that some row has, as read back from their JSON."""
    run = _run(spark, sf_dir)
    counts = flags.flag_counts(run.data, [r.flag_value for r in run.rules]).where("row_count > 0")
    used = flags.issues_of_rules(spark, run.rules).join(counts, "flag_value", "left_semi")
    return issues.issue_metrics(issues.from_json(issues.to_json(used)))


@query("""
WITH n AS (
  SELECT n_nationkey AS k, count(s_suppkey) AS n, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS even,
    min(s_suppkey) AS first
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 3000 GROUP BY 1)
SELECT k AS n_nationkey, k % 5 <> 4 AS valid, CASE WHEN k % 5 = 4 THEN 0 ELSE n END AS total_issues,
  CASE WHEN k % 5 = 4 THEN 0 ELSE even END AS n_high,
  CASE WHEN k % 5 IN (1, 4) THEN 85 WHEN k % 5 = 0 THEN greatest(100 - 15 * n, 10) WHEN k % 5 = 2 THEN k ELSE k + 50 END AS data_quality_score,
  CASE WHEN k % 5 = 4 OR first IS NULL THEN 'none' ELSE 'balance' END AS first_columns,
  CASE WHEN k % 5 = 4 THEN '' WHEN k % 2 = 0 THEN 'check all' ELSE 'a,b' END AS recommendations,
  CASE WHEN k % 5 = 4 THEN 'n_name' ELSE 'Nation' END AS renamed, CASE WHEN k % 5 = 4 THEN 0 ELSE n END AS n_flags
FROM n
""")
def result_records(spark, sf_dir):
    """Whole result records of varying shape, read, written and read again; their issues as flags.

    A nation's record lists its suppliers of low balance; scores are null, absent, texts or numbers, and
    every fifth text is no JSON object.
    """
    from dqspark.operators import issues as records

    supplier = table(spark, sf_dir, "supplier").where("s_acctbal < 3000")
    listed = table(spark, sf_dir, "nation").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    severity = F.when(F.col("s_suppkey") % 2 == 0, "high")
    columns = F.when(F.col("s_suppkey") % 2 == 0, F.lit('["balance"]')).otherwise(F.lit('"balance"'))
    issue = F.concat(F.lit('{"affected_columns":'), columns, F.coalesce(F.concat(F.lit(',"severity":"'), severity, F.lit('"')), F.lit("")), F.lit("}"))
    texts = listed.groupBy("n_nationkey").agg(F.concat_ws(",", F.collect_list(F.when(F.col("s_suppkey").isNotNull(), issue))).alias("issues"))
    k = F.col("n_nationkey")
    score = (
        F.when(k % 5 == 0, F.lit(',"data_quality_score":null')).when(k % 5 == 1, F.lit(""))
        .when(k % 5 == 2, F.concat(F.lit(',"data_quality_score":"'), k.cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit(',"data_quality_score":'), (k + 50).cast("string")))
    )
    advice = F.when(k % 2 == 0, F.lit('"check all"')).otherwise(F.lit('["a","b"]'))
    text = F.concat(
        F.lit('{"issues":['), "issues", F.lit('],"column_renaming":{"n_name":"Nation"},"recommendations":'), advice, score, F.lit("}")
    )
    given = texts.select("n_nationkey", F.when(k % 5 == 4, F.lit("no result")).otherwise(text).alias("json"))
    first = records.read_records(given, columns=["n_name", "n_regionkey"], keep=["n_nationkey"])
    again = records.read_records(records.record_json(first, ["n_nationkey"]), keep=["n_nationkey"])
    bits = records.record_issues(again, ["n_nationkey"]).groupBy("n_nationkey").agg(F.count_distinct("flag_word", "flag_value").alias("n_flags"))
    rows = again.drop("valid").join(first.select("n_nationkey", "valid"), "n_nationkey").join(bits, "n_nationkey", "left")
    return rows.select(
        "n_nationkey", "valid", "total_issues", F.size(F.filter("issues", lambda i: i["severity"] == "high")).cast("bigint").alias("n_high"),
        "data_quality_score",
        F.coalesce(F.array_join(F.try_element_at("issues", F.lit(1))["affected_columns"], ","), F.lit("none")).alias("first_columns"),
        F.array_join("recommendations", ",").alias("recommendations"),
        F.col("column_renaming")["n_name"].alias("renamed"), F.coalesce("n_flags", F.lit(0)).alias("n_flags"),
    )


@query(FLAGGED + "SELECT booking_id, CASE WHEN flag_status = 0 THEN 'No flags' ELSE 'Flags: ' || "
       f"array_to_string({SET_FLAGS}, '+') END AS flags, lpad(bin(flag_status), 8, '0') AS bits FROM flagged")
def flag_texts(spark, sf_dir):
    """Status in words and in binary digits for every row."""
    from dqspark.functions.flagbits import flags_text

    status = F.col("flag_status")
    data = _run(spark, sf_dir).data
    return data.select("booking_id", flags_text(status).alias("flags"), binary_text(status, 8).alias("bits"))


WIDE_RULES = 200
WIDE = f"""
WITH p AS (SELECT o_orderkey, list_sort(list_distinct(list_filter([o_orderkey % 211, o_custkey % 97], lambda x: x < {WIDE_RULES}))) AS p FROM orders)
"""


def _wide_run(spark, sf_dir):
    from dqspark.operators.wideflags import flag_rows_wide

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    code = "o_orderkey % 211 = {0} OR o_custkey % 97 = {0}"
    columns = ("o_orderkey", "o_custkey")
    return flag_rows_wide(orders, [rules.Rule(code.format(i), columns, f"remainder {i}") for i in range(WIDE_RULES)])


@query(WIDE + "SELECT o_orderkey, CAST(len(p) AS INTEGER) AS n_flags, array_to_string(p, ',') AS positions FROM p")
def wide_flag_rows(spark, sf_dir):
    """Two hundred rules on every row."""
    from dqspark.operators import wideflags as wide

    words = F.col("flag_words")
    positions = F.array_join(wide.positions(words), ",")
    return _wide_run(spark, sf_dir).data.select("o_orderkey", wide.count_flags(words).alias("n_flags"), positions.alias("positions"))


@query(WIDE + """
, n AS (SELECT unnest(p) AS position, o_orderkey FROM p)
SELECT CAST(r.i AS INTEGER) AS position, count(n.position) AS rows_detected, true AS success, 'remainder ' || r.i AS explanation
FROM (SELECT unnest(range(200)) AS i FROM (SELECT count(*) FROM orders)) r LEFT JOIN n ON n.position = r.i GROUP BY r.i
""")
def wide_rule_results(spark, sf_dir):
    """Rows per rule, of two hundred."""
    return _wide_run(spark, sf_dir).rule_results().select("position", "rows_detected", "success", "explanation")


@query(WIDE + """
SELECT array_to_string(p, ',') AS positions, count(*) AS row_count,
  '1' || array_to_string(list_transform(range(p[-1]), lambda i: CASE WHEN list_contains(p, p[-1] - 1 - i) THEN '1' ELSE '0' END), '') AS binary_representation
FROM p WHERE len(p) > 0 GROUP BY p
""")
def wide_flag_combos(spark, sf_dir):
    """Combinations of flags beyond 63 bits."""
    from dqspark.operators.wideflags import flag_combinations as wide_combinations

    found = wide_combinations(_wide_run(spark, sf_dir).data, WIDE_RULES)
    return found.select(F.array_join("positions", ",").alias("positions"), "row_count", "binary_representation")
