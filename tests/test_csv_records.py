"""Bad CSV rows and whole result records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dqspark.operators import issues, profile
from dqspark.sources import readers


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,a,zzz\n2,b\n\nbad,c\n3\n4,"q, r"\n')
    (tmp_path / "b.csv").write_text('x,y\n5,"say ""hi"", you",more\n6,z\n')
    return str(tmp_path)


def test_rejects_name_file_and_line(spark, folder):
    got = {(r["file"].rsplit("/", 1)[1], r["line"], r["kind"], r["column"], r["value"]) for r in readers.csv_rejects(spark, folder, "x int, y string").collect()}
    assert got == {
        ("a.csv", 2, "surplus", None, "1,a,zzz"),
        ("a.csv", 5, "unreadable", "x", "bad"),
        ("a.csv", 6, "short", None, "3"),
        ("b.csv", 2, "surplus", None, '5,"say ""hi"", you",more'),
    }
    assert {r["kind"] for r in readers.csv_rejects(spark, folder, multi_line=True).collect()} == {"surplus", "short"}


def test_bad_rows_raise_unless_told(spark, folder):
    with pytest.raises(Exception, match="more than 2 cells"):
        readers.read_csv(spark, f"{folder}/b.csv").select("y").collect()
    lenient = readers.read_csv(spark, folder, "x int, y string", bad_rows="null")
    rows = {tuple(r) for r in lenient.collect()}
    assert rows == {(1, "a"), (2, "b"), (None, "c"), (3, None), (4, "q, r"), (5, 'say "hi", you'), (6, "z")}


def test_unreadable_cells_raise(spark, tmp_path):
    (tmp_path / "c.csv").write_text("x,y\n1,NA\nbad,c\n")
    with pytest.raises(Exception, match="column x is no int: bad"):
        readers.read_csv(spark, str(tmp_path), "x int, y string").collect()
    (tmp_path / "c.csv").write_text("x,y\n1,NA\nNA\n")
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path), "x int, y string").collect()} == {(1, None), (None, None)}


def test_records_of_any_shape(spark):
    texts = [
        json.dumps({"total_issues": 2, "issues": [{"category": "c"}, {"affected_columns": "one", "severity": "low"}], "data_quality_score": None}),
        json.dumps({"issues": "none", "column_renaming": {"a": "A"}, "recommendations": "all", "data_quality_score": "77"}),
        json.dumps({"issues": [{"affected_columns": ["x", "y"], "description": "d", "fix_approach": "f"}, 5]}),
        "not json", "[1]", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    got = {r["i"]: r for r in issues.read_records(df, columns=["a", "b"], keep=["i"]).collect()}
    assert [got[i]["valid"] for i in range(6)] == [True, True, True, False, False, False]
    assert [got[i]["total_issues"] for i in range(6)] == [2, 0, 2, 0, 0, 0]
    assert [got[i]["data_quality_score"] for i in range(6)] == [70, 77, 85, 85, 85, 85]
    first = got[0]["issues"]
    assert (first[0]["category"], first[0]["description"], first[0]["severity"]) == ("c", "Issue 1", "medium")
    assert first[1]["affected_columns"] == ["one"] and first[1]["severity"] == "low"
    assert got[1]["recommendations"] == ["all"] and got[1]["column_renaming"] == {"a": "A", "b": "b"}
    assert got[2]["issues"][0]["affected_columns"] == ["x", "y"] and got[2]["issues"][1]["description"] == "Issue 2"
    again = issues.read_records(issues.record_json(issues.read_records(df, keep=["i"]), ["i"]), keep=["i"])
    assert {r["i"]: r["issues"] for r in again.collect()} == {i: r["issues"] for i, r in got.items()}
    flags = issues.record_issues(again, ["i"]).where("i = 0").collect()
    assert [r["flag_value"] for r in flags] == [1, 2]
    assert issues.issue_metrics(issues.record_issues(again), supplied=12).first()["data_quality_score"] == 12


def test_records_of_more_issues_than_bits(spark):
    texts = [json.dumps({"issues": [{"category": str(i)} for i in range(n)]}) for n in (63, 64, 130)]
    records = issues.read_records(spark.createDataFrame(list(enumerate(texts)), "i int, json string"), keep=["i"])
    flags = issues.record_issues(records, ["i"]).collect()
    place = {(r["i"], int(r["category"])): (r["flag_word"], r["flag_value"]) for r in flags}
    assert place == {(i, p): (p // 63, 1 << (p % 63)) for i, n in enumerate((63, 64, 130)) for p in range(n)}


def test_result_records_with_many_suppliers(spark, tmp_path):
    """More suppliers of a nation than a status has bits: all are counted."""
    from dqspark.queries import QUERIES

    spark.range(6).selectExpr("CAST(id AS int) AS n_nationkey", "'n' AS n_name", "0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    suppliers = spark.range(300).selectExpr("id AS s_suppkey", "CAST(CASE WHEN id < 200 THEN 1 ELSE id % 6 END AS int) AS s_nationkey", "10.0D AS s_acctbal")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["n_nationkey"]: r for r in QUERIES["result_records"](spark, str(tmp_path)).collect()}
    n = {r["k"]: r["n"] for r in suppliers.groupBy("s_nationkey").count().toDF("k", "n").collect()}
    assert n[1] > 126 and {k: (r["total_issues"], r["n_flags"]) for k, r in got.items()} == {k: (0, 0) if k == 4 else (n[k], n[k]) for k in range(6)}


def test_totals_of_an_imputation(spark):
    before = spark.createDataFrame([(None, None), (1, None), (2, "x")], "a int, b string")
    after = before.withColumn("a", F.coalesce("a", F.lit(9))).withColumn("b", F.when(F.col("a") == 1, "y").otherwise(F.col("b")))
    got = profile.imputation_totals(before, after).first()
    assert tuple(got) == (3, 1, 2, ["a"], ["b"], ["a"])
