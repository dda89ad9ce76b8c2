"""Joins (J1-J11) and the flagship question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.operators.analyze import DESCENDING, AnalysisSpec, Metric, answer
from dqspark.operators.clean import find_prefixes, strip_prefixes
from dqspark.operators.flags import flag_rows
from dqspark.operators.joins import JoinSpec, join_chain, join_preview, join_summary, join_tables
from dqspark.operators.rules import negative
from dqspark.queries.registry import BOOKINGS_CTE, bookings, query, table


@query("""
SELECT regexp_replace(n_name, '^NATION_', '') AS n_name, CAST(count(*) AS BIGINT) AS n_customers,
  round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*), 2) AS debt_rate
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1
""")
def flagship_debt_rate(spark, sf_dir):
    """Which nations have the highest share of accounts in debt?"""
    nation = table(spark, sf_dir, "nation")
    nation = strip_prefixes(nation, find_prefixes(nation, ["n_name"]))
    spec = JoinSpec("nation", "c_nationkey", "n_nationkey", "left", ["n_name"])
    joined = join_tables(table(spark, sf_dir, "customer"), nation, spec)
    in_debt = negative("c_acctbal")
    flagged = flag_rows(joined, [in_debt]).data
    rate = Metric("debt_rate", "rate", condition=in_debt.detection_code)
    question = AnalysisSpec(
        [Metric("n_customers", "count"), rate], ["n_name"], order=DESCENDING, order_by="debt_rate"
    )
    return answer(flagged, question)


@query("""
SELECT o_orderkey, o_totalprice, l_orderkey, l_linenumber, l_extendedprice
FROM orders LEFT JOIN lineitem ON o_orderkey IS NOT DISTINCT FROM l_orderkey
""")
def join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    spec = JoinSpec("lineitem", "o_orderkey", "l_orderkey", "left", ["l_linenumber", "l_extendedprice"])
    return join_tables(orders, table(spark, sf_dir, "lineitem"), spec)


@query("SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_inner(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return join_tables(documents, table(spark, sf_dir, "labels"), JoinSpec("labels", "doc_id", "doc_id", "inner"))


@query("""
SELECT d.doc_id, quality, toxic, lang, n_chars FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id
""")
def join_right(spark, sf_dir):
    spec = JoinSpec("documents", "doc_id", "doc_id", "right", ["lang", "n_chars"])
    return join_tables(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), spec)


@query("""
SELECT c_custkey, c_acctbal, p_partkey, p_retailprice FROM customer FULL JOIN part ON c_custkey = p_partkey
""")
def join_full(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    spec = JoinSpec("part", "c_custkey", "p_partkey", "outer", ["p_retailprice"])
    return join_tables(customer, table(spark, sf_dir, "part"), spec)


@query(BOOKINGS_CTE + """
, c AS (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS cust_n, c_mktsegment FROM customer)
SELECT b.booking_id, b.cust_n, c.c_mktsegment
FROM bookings b JOIN c ON b.cust_n IS NOT DISTINCT FROM c.cust_n
""")
def join_null_keys(spark, sf_dir):
    """Bookings without a customer meet the customer without a key."""
    customer = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("cust_n"), "c_mktsegment"
    )
    left = bookings(spark, sf_dir).select("booking_id", "cust_n")
    return join_tables(left, customer, JoinSpec("customer", "cust_n", "cust_n", "inner"))


@query(BOOKINGS_CTE + """
SELECT booking_id, layovers, CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name
FROM bookings LEFT JOIN region ON layovers = CAST(r_regionkey AS VARCHAR)
""")
def join_key_types(spark, sf_dir):
    """A text key meets a number key."""
    left = bookings(spark, sf_dir).select("booking_id", "layovers")
    return join_tables(left, table(spark, sf_dir, "region"), JoinSpec("region", "layovers", "r_regionkey"))


CHAIN = [
    JoinSpec("customer", "o_custkey", "c_custkey", "left", ["c_nationkey", "c_mktsegment"]),
    JoinSpec("nation", "c_nationkey", "n_nationkey", "left", ["n_name", "n_regionkey"]),
    JoinSpec("region", "n_regionkey", "r_regionkey", "inner", ["r_name"]),
]
CHAIN_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_nationkey, c_mktsegment, n_nationkey, n_name, n_regionkey,
  r_regionkey, r_name
FROM {orders} LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def _chain_tables(spark, sf_dir) -> dict[str, DataFrame]:
    names = ("customer", "nation", "region")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return {"orders": orders, **{n: table(spark, sf_dir, n) for n in names}}


@query(CHAIN_SQL.format(orders="orders"), name="join_chain")
def chain(spark, sf_dir):
    return join_chain(_chain_tables(spark, sf_dir), "orders", CHAIN)


@query(CHAIN_SQL.format(orders="(SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)") + " ORDER BY o_orderkey LIMIT 10", name="join_preview")
def preview(spark, sf_dir):
    return join_preview(_chain_tables(spark, sf_dir), "orders", CHAIN, ["o_orderkey"])


@query("""
SELECT n.n_nationkey, n.n_name, s.s_suppkey, s.n_name AS n_name_supplier
FROM (SELECT s_suppkey, s_nationkey, s_name AS n_name FROM supplier) s
JOIN nation n ON n.n_nationkey = s.s_nationkey
""")
def join_name_clash(spark, sf_dir):
    """The secondary table's column of the same name gets the table's name."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("n_name"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    spec = JoinSpec("supplier", "n_nationkey", "s_nationkey", "inner", ["s_suppkey", "n_name"])
    return join_tables(nation, supplier, spec).drop("s_nationkey")


@query("""
SELECT CAST(1 AS INTEGER) AS step, 'left join with customer on o_custkey=c_custkey' AS description,
  (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) AS n_rows
UNION ALL SELECT 2, 'left join with nation on c_nationkey=n_nationkey',
  (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
   LEFT JOIN nation ON c_nationkey = n_nationkey)
UNION ALL SELECT 3, 'inner join with region on n_regionkey=r_regionkey',
  (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
   LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
""")
def join_steps(spark, sf_dir):
    """The chain in words with the rows after each step."""
    tables = _chain_tables(spark, sf_dir)
    counts = [
        join_chain(tables, "orders", CHAIN[: i + 1]).agg(F.lit(i + 1).alias("step"), F.count("*").alias("n_rows"))
        for i in range(len(CHAIN))
    ]
    rows = reduce(DataFrame.unionByName, counts)
    return join_summary(spark, "orders", CHAIN).join(rows, "step").select("step", "description", "n_rows")


@query("""
WITH a AS (SELECT o_orderkey, 9007199254740992 + o_orderkey % 7 AS big FROM orders),
b AS (SELECT CAST(9007199254740992 + 2 * n_nationkey AS DOUBLE) AS big, n_name FROM nation WHERE n_nationkey < 3)
SELECT o_orderkey, n_name FROM a LEFT JOIN b ON a.big = CAST(b.big AS BIGINT)
""")
def join_big_keys(spark, sf_dir):
    """Whole numbers that share a double do not meet."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "9007199254740992L + o_orderkey % 7 AS big")
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 3")
    nations = nations.selectExpr("CAST(9007199254740992L + 2 * n_nationkey AS DOUBLE) AS big", "n_name")
    return join_tables(orders, nations, JoinSpec("nation", "big", "big")).select("o_orderkey", "n_name")


@query("""
WITH a AS (SELECT o_orderkey, 9007199254740992 + o_orderkey % 7 AS big FROM orders),
b AS (SELECT CAST(9007199254740992 + 2 * n_nationkey AS DOUBLE) AS big, n_name FROM nation)
SELECT o_orderkey, n_name FROM a LEFT JOIN b ON a.big = CAST(b.big AS BIGINT)
""")
def join_big_keys_all(spark, sf_dir):
    """Whole numbers that share a double do not meet, over all nations."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "9007199254740992L + o_orderkey % 7 AS big")
    nations = table(spark, sf_dir, "nation").selectExpr("CAST(9007199254740992L + 2 * n_nationkey AS DOUBLE) AS big", "n_name")
    return join_tables(orders, nations, JoinSpec("nation", "big", "big")).select("o_orderkey", "n_name")


@query("""
WITH a AS (SELECT o_orderkey, CAST(o_custkey AS DECIMAL(20, 15)) + CASE WHEN o_orderkey % 3 = 0 THEN 0.000000000000001 ELSE 0 END AS k FROM orders),
b AS (SELECT c_custkey AS j, c_name FROM customer)
SELECT o_orderkey, k, j, c_name FROM a LEFT JOIN b ON k = CAST(j AS DECIMAL(35, 15))
""")
def join_decimal_keys(spark, sf_dir):
    """Decimal keys meet whole numbers only where they are whole themselves, and stay as they are."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        # 19 digits before the point hold any bigint
        "CAST(CAST(o_custkey AS DECIMAL(34, 15)) + CASE WHEN o_orderkey % 3 = 0 THEN 0.000000000000001BD ELSE 0 END AS DECIMAL(34, 15)) AS k",
    )
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey AS j", "c_name")
    return join_tables(orders, customer, JoinSpec("customer", "k", "j"))


@query(BOOKINGS_CTE + """
, b AS (SELECT booking_id, CASE WHEN booking_id % 2 = 0 THEN NULL ELSE cust_n END AS half_n FROM bookings),
c AS (SELECT CASE WHEN c_custkey % 300 = 0 THEN NULL ELSE c_custkey END AS cust_n, c_mktsegment FROM customer)
SELECT c.cust_n, c_mktsegment, booking_id, half_n FROM c LEFT JOIN b ON c.cust_n IS NOT DISTINCT FROM b.half_n
""")
def join_null_hot_right(spark, sf_dir):
    """Half of the looked-up side has no key: its rows are split, and the others' copied to each part."""
    right = bookings(spark, sf_dir).selectExpr("booking_id", "CASE WHEN booking_id % 2 = 0 THEN NULL ELSE cust_n END AS half_n")
    customer = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 300 = 0 THEN NULL ELSE c_custkey END AS cust_n", "c_mktsegment")
    return join_tables(customer, right, JoinSpec("bookings", "cust_n", "half_n", "left", hot_rows=1000))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS uid FROM events)
SELECT event_id, uid, c_custkey, c_name FROM e RIGHT JOIN customer ON uid = c_custkey
""")
def join_hot_right_join(spark, sf_dir):
    """A third of the looked-up rows of a right join has one key."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS uid")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return join_tables(events, customer, JoinSpec("customer", "uid", "c_custkey", "right", hot_rows=1000))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS uid FROM events),
c AS (SELECT CASE WHEN c_custkey = 5 THEN NULL ELSE c_custkey END AS cust_n, c_name FROM customer)
SELECT event_id, uid, cust_n, c_name FROM e FULL JOIN c ON uid IS NOT DISTINCT FROM cust_n
""")
def join_hot_full(spark, sf_dir):
    """A full join with a third of the left rows under the missing key."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS uid")
    customer = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey = 5 THEN NULL ELSE c_custkey END AS cust_n", "c_name")
    return join_tables(events, customer, JoinSpec("customer", "uid", "cust_n", "outer", hot_rows=1000))
