"""Sources and sinks (S1-S11): what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators.columns import friendly_names
from dqspark.operators.impute import Strategy
from dqspark.operators.joins import JoinSpec
from dqspark.operators.flags import flag_rows
from dqspark.plans.cleaning import prepare
from dqspark.plans.quality import check
from dqspark.queries.flagging import FLAGGED, ISSUES, RULES
from dqspark.queries.registry import bookings, query, table
from dqspark.session import new_folder
from dqspark.sources import readers, sinks


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer")
def csv_reread(spark, sf_dir):
    """CSV out and in again: types are found again, N/A texts are missing."""
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment"))
    customer = table(spark, sf_dir, "customer").withColumn("c_mktsegment", segment)
    path = sinks.write_table(customer, f"{new_folder(spark)}/customer", "csv")
    return readers.require_rows(readers.read_csv(spark, path))


@query("""
WITH n AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS t, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer)
SELECT line, 'surplus' AS kind, NULL AS "column", t || ',"a, b",zzz' AS value FROM n WHERE k % 50 = 1
UNION ALL SELECT line, 'short', NULL, t FROM n WHERE k % 50 = 2
UNION ALL SELECT line, 'unreadable', 'k', 'no' || t FROM n WHERE k % 50 = 3
""")
def csv_bad_rows(spark, sf_dir):
    """Lines with too many or too few cells and unreadable cells, each with its line."""
    k = F.col("c_custkey")
    line = (
        F.when(k % 50 == 1, F.concat(k.cast("string"), F.lit(',"a, b",zzz'))).when(k % 50 == 2, k.cast("string"))
        .when(k % 50 == 3, F.concat(F.lit("no"), k.cast("string"), F.lit(",x"))).otherwise(F.concat(k.cast("string"), F.lit(',"quoted "" text, too"')))
    )
    path = f"{new_folder(spark)}/lines"
    customer = table(spark, sf_dir, "customer")
    header = spark.createDataFrame([(-1, "k,t")], "k bigint, value string")
    # one sorted file, so that line numbers are known
    lines = header.unionByName(customer.select(k.alias("k"), line.alias("value"))).orderBy("k").select("value")
    lines.coalesce(1).write.text(path)
    return readers.csv_rejects(spark, path, "k bigint, t string").drop("file")


@query(FLAGGED + ISSUES + """
SELECT CAST(flag_value AS BIGINT) AS flag_value, description, severity, affected_columns,
  (SELECT count(*) FROM flagged WHERE (flag_status & flag_value) <> 0) AS row_count FROM issues
""")
def roundtrip_flags(spark, sf_dir):
    """Rules, flag table and flagged data are stored, read back and run again."""
    folder = new_folder(spark)
    checked = check(bookings(spark, sf_dir), RULES)
    checked.export(folder)
    rules_again = readers.read_rules(spark, f"{folder}/rules")
    issues_again = readers.read_issues(spark, f"{folder}/flag_table/flags")
    data = readers.with_status(readers.final_table(spark, None, f"{folder}/flagged_data"))
    run = flag_rows(data.drop("flag_status"), rules_again)
    counts = run.rule_results().select("flag_value", F.col("rows_detected").alias("row_count"))
    joined = issues_again.join(counts, "flag_value")
    return joined.select(
        "flag_value", "description", "severity", F.array_join("affected_columns", ", ").alias("affected_columns"), "row_count"
    )


@query("""
SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'joined', count(*) FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'renaming_report', CAST(4 AS BIGINT) FROM (SELECT count(*) FROM supplier)
""")
def export_all(spark, sf_dir):
    """Every stage under one directory."""
    folder = new_folder(spark)
    tables = readers.read_tables(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("nation", "supplier")})
    joined = prepare(tables, "supplier", [JoinSpec("nation", "s_nationkey", "n_nationkey")], case=None).data
    renames = friendly_names(tables["supplier"].columns)
    written = sinks.export_all(spark, folder, {**tables, "joined": joined}, renamings=renames)
    counts = [
        readers.read_table(spark, path, "json" if name == "renaming_report" else "parquet").agg(
            F.lit(name).alias("name"), F.count("*").alias("n_rows")
        )
        for name, path in written.items()
    ]
    first, *rest = counts
    for other in rest:
        first = first.unionByName(other)
    return first


@query("""
SELECT o_orderkey, o_custkey, o_totalprice,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
    WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END AS o_orderpriority,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment, substr(n_name, 8) AS n_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def prepared_orders(spark, sf_dir):
    """Join, clean and fill in one go, with the cleaned table stored in between."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    tables["orders"] = tables["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    joins = [
        JoinSpec("customer", "o_custkey", "c_custkey", "left", ["c_nationkey", "c_mktsegment"]),
        JoinSpec("nation", "c_nationkey", "n_nationkey", "left", ["n_name"]),
    ]
    done = prepare(tables, "orders", joins, {"o_totalprice": Strategy.MEDIAN}, store=f"{new_folder(spark)}/cleaned")
    return done.data.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "c_mktsegment", "n_name")
