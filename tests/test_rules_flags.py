from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dqspark.operators import flags, issues, rules
from dqspark.operators.columns import friendly_names, full_renames, rename, valid_renames


def hits(spark, rule, rows, ddl):
    df = spark.createDataFrame(rows, ddl).withColumn("__i", F.monotonically_increasing_id()).coalesce(1)
    run = flags.flag_rows(df, [rule])
    assert not run.errors[1]
    return [r["flag_status"] for r in run.data.orderBy("__i").collect()]


def test_counts_and_lists(spark):
    rule = rules.count_mismatch("c", "l")
    rows = [("2.7", "a;b"), ("-2.7", "a"), ("abc", ""), (None, None), ("1", " ; ")]
    assert hits(spark, rule, rows, "c string, l string") == [0, 1, 0, 0, 1]


def test_negative_and_blank(spark):
    assert hits(spark, rules.negative("c"), [("-1",), ("x",), (None,), ("2",)], "c string") == [1, 0, 0, 0]
    assert hits(spark, rules.blank("c"), [(" \t",), ("x",), (None,)], "c string") == [1, 0, 1]


def test_dates(spark):
    rows = [("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-02"), ("bad", "2024-01-01"), (None, "2024-01-01")]
    assert hits(spark, rules.starts_after_end("a", "b"), rows, "a string, b string") == [1, 0, 0, 0]


def test_duration_in_days(spark):
    rule = rules.duration_mismatch("a", "b", "d", 86400, 0.01)
    rows = [("2024-01-01", "2024-01-03", 2.0), ("2024-01-01", "2024-01-03", 3.0), (None, "2024-01-03", 3.0)]
    assert hits(spark, rule, rows, "a string, b string, d double") == [0, 1, 0]


def test_parts(spark):
    rows = [(10.0, 4.0, 6.0), (10.0, 4.0, 7.0), (10.0, None, 7.0)]
    assert hits(spark, rules.total_mismatch("t", ["a", "b"], 0.5), rows, "t double, a double, b double") == [0, 1, 0]
    rows = [(2.0, 4.0, 2.0), (3.0, 4.0, 2.0), (3.0, 4.0, 0.0)]
    assert hits(spark, rules.average_mismatch("m", "t", "n", 0.1), rows, "m double, t double, n double") == [0, 1, 0]
    rows = [(50.0, 1.0, 2.0), (40.0, 1.0, 2.0)]
    assert hits(spark, rules.percentage_mismatch("p", "a", "b"), rows, "p double, a double, b double") == [0, 1]


@pytest.mark.parametrize(
    "value, wanted",
    [("aBc", 1), ("Abc", 0), ("ABC", 0), ("abc", 0), ("B", 0), ("a  b", 1), ("a@b", 1), ("", 0), (None, 0), ("O'Neil", 0)],
)
def test_unusual_text(spark, value, wanted):
    assert hits(spark, rules.unusual_text("c"), [(value,)], "c string") == [wanted]


def test_rare_formats(spark):
    df = spark.createDataFrame([(f"AB-{i:02d}",) for i in range(30)] + [("x/1",), (None,)], "c string")
    shapes = rules.common_shapes(df, "c", 0.2)
    assert shapes == ["AA-99"]
    flagged = flags.flag_rows(df, [rules.rare_format("c", shapes)]).data.where("flag_status > 0")
    assert [r["c"] for r in flagged.collect()] == ["x/1"]


def test_pairs_by_name(spark):
    df = spark.createDataFrame(
        [], "passengers int, passenger_names string, items_count int, items_list string, layovers int, "
        "layover_locations string, price double, notes string"
    )
    assert rules.count_list_pairs(df) == [
        ("passengers", "passenger_names"), ("items_count", "items_list"), ("layovers", "layover_locations"),
    ]


def test_rules_from_names_and_values(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(1, 20)] + [(5000.0, -1.0)], "fare double, mileage double")
    explained = {r.explanation for r in rules.suggest_rules(df)}
    assert {"fare is negative", "mileage is negative", "fare is an outlier", "fare is extremely high"} <= explained
    run = flags.flag_rows(df, rules.suggest_rules(df))
    assert run.data.where("flag_status > 0").count() == 1


@pytest.mark.parametrize(
    "code",
    ["sum(a) > 1", "row_number() OVER (ORDER BY a) > 1", "b > 1", "a", "a >", "a IN (SELECT 1)", "explode(array(true))"],
)
def test_unusable_rules(spark, code):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    run = flags.flag_rows(df, [rules.Rule(code, ("a",), "x"), rules.negative("b")])
    assert run.errors[1] and not run.errors[2]
    assert [r["flag_status"] for r in run.data.collect()] == [0]
    results = {r["flag_value"]: r for r in run.rule_results().collect()}
    assert not results[1]["success"] and results[1]["error"] and results[2]["success"]
    assert run.summary().first()["success_rate"] == 50.0


def test_quoted_words_are_no_subquery(spark):
    df = spark.createDataFrame([("from",)], "a string")
    assert rules.check_rule(df, rules.Rule("a = 'select from'", ("a",), "x")) == ""


def test_no_rules_flag_nothing(spark):
    run = flags.flag_rows(spark.range(3), [])
    assert run.data.where("flag_status <> 0").count() == 0
    assert run.summary().first()["success_rate"] is None


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        flags.flag_rows(spark.range(1), [rules.negative("id")] * 64)


def test_sixty_three_flags(spark):
    df = spark.createDataFrame([(-1,), (1,)], "a int")
    run = flags.flag_rows(df, [rules.negative("a")] * 63)
    assert sorted(r["flag_status"] for r in run.data.collect()) == [0, 2**63 - 1]
    assert run.summary().first()["total_detections"] == 63


def test_one_projection_and_no_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    used = [rules.negative("c_acctbal"), rules.blank("c_name"), rules.unusual_text("c_mktsegment")]
    plan = flags.flag_rows(df, used).data._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Exchange" not in plan


def test_combinations_add_up(spark):
    df = spark.createDataFrame([(-1, ""), (1, None), (-2, "x"), (3, "y")], "a int, b string")
    run = flags.flag_rows(df, [rules.negative("a"), rules.blank("b")])
    combos = {r["flag_status"]: r for r in flags.flag_combinations(run.data).collect()}
    assert {k: r["row_count"] for k, r in combos.items()} == {1: 1, 2: 1, 3: 1}
    assert combos[3]["flag_description"] == "Flags 1+2" and combos[3]["binary_representation"] == "11"
    clean = run.data.where("flag_status = 0").count()
    assert clean + sum(r["row_count"] for r in combos.values()) == 4
    sample = flags.flagged_sample(run.data, 1, ["a"]).first()
    assert sample["flag_breakdown"] == "Flags: 1"
    table = flags.issues_of_rules(spark, run.rules)
    assert flags.decoded(run.data, table, ["a"]).count() == 4
    assert [r["issues"] for r in flags.possible_combinations(table).orderBy("combined").collect()][2] == [
        "a is negative", "b is missing or blank",
    ]


def test_issue_defaults(spark):
    table = flags.issue_table(spark, [{}, {"description": "d", "severity": "high"}])
    first, second = table.orderBy("flag_value").collect()
    assert (first["description"], first["category"], first["severity"]) == ("Issue 1", "unknown", "medium")
    assert second["flag_value"] == 2
    totals = flags.flag_table_summary(table).first()
    assert (totals["total_flags"], totals["max_combined_value"], int(totals["possible_combinations"])) == (2, 3, 3)
    assert issues.issue_metrics(table).first()["data_quality_score"] == 70


def test_renaming_issues_one_after_the_other(spark):
    table = flags.issue_table(
        spark, [{"description": "a and b", "affected_columns": ["a", "c"], "fix_approach": "drop a"}]
    )
    row = issues.rename_in_issues(table, {"a": "bb", "b": "x"}).first()
    # the second name is looked for in the text that holds the first new name
    assert row["affected_columns"] == ["bb", "c"] and row["description"] == "xx xnd x".replace("xnd", "xxnd")
    assert row["fix_approach"] == "drop xx"


def test_names():
    assert valid_renames({"a": " b ", "b": "b", "c": "Use clear name", "d": " "}) == {"a": "b"}
    assert full_renames({"a": "b"}, ["a", "c"]) == {"a": "b", "c": "c"}
    assert friendly_names(["o_orderKey", "o_custkey"]) == {"o_orderKey": "order_key", "o_custkey": "custkey"}
    assert friendly_names(["Gate No.", "id"]) == {"Gate No.": "gate_no", "id": "id"}


def test_rename_collision(spark):
    with pytest.raises(ValueError):
        rename(spark.createDataFrame([], "a int, b int"), {"a": "b"})
