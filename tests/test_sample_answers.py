from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dqspark.operators import analyze, conversation, sample
from dqspark.operators.analyze import AnalysisSpec, Metric, answer
from dqspark.operators.pipetables import pipe_tables
from dqspark.plans.answers import ask


def people(spark, n=2000):
    rows = [(i, f"p{i}", None if i % 3 else "x", 10_000.0 if i == 7 else -5.0 if i == 9 else float(i % 10), "aB" if i == 11 else "ab") for i in range(n)]
    return spark.createDataFrame(rows, "id int, name string, gap string, price double, word string")


def test_small_table_is_returned_whole(spark):
    df = people(spark, 20)
    got = sample.take_sample(df, ["id"], 20)
    assert got.count() == 20 and {r["reason"] for r in got.collect()} == {"full_dataset"}


def test_sample_is_a_part_of_the_table(spark):
    df = people(spark)
    got = sample.take_sample(df, ["id"], 100).collect()
    assert len(got) <= 100 and len({r["id"] for r in got}) == len(got)
    reasons = {r["id"]: r["reason"] for r in got}
    assert list(reasons.values()).count("random") == 30
    assert reasons[7] in ("random", "outlier:price", "extreme:price")
    assert any(r == "negative:price" or reasons.get(9) for r in reasons.values())
    again = sample.take_sample(df.repartition(7), ["id"], 100).collect()
    assert {r["id"]: r["reason"] for r in again} == reasons


def test_limit_is_applied_before_the_shuffle(spark):
    df = people(spark)
    found = sample.candidates(df, ["id"], sample.issue_strata(df, 40, 1, sample.quartile_pairs(df)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_marked_rows_are_kept_in_buffers(spark):
    """No sort below the first buffer, and the same rows as by sorting all marked ones."""
    values = [None, float("nan"), float("inf"), -0.0, 0.0, -1.5, 2.0]
    rows = [(values[i % 7], f"ä{i % 11}" if i % 13 else None, decimal.Decimal(i * 37 % 1009) / 100, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "d double, s string, m decimal(10,2), i int").repartition(6)
    strata = [sample.Stratum("issue", "all", F.lit(True), 50), sample.Stratum("issue", "odd", F.col("i") % 2 == 1, 7), sample.Stratum("issue", "no", F.lit(False), 5)]
    for keys in (["d", "s", "i"], ["s", "m", "i"], ["m", "i"], ["i"]):
        got = sample.candidates(df, keys, strata)
        whole = sample._marked(df, keys, list(enumerate(strata)))
        at = F.row_number().over(Window.partitionBy("stratum").orderBy(*keys))
        want = whole.withColumn("at", at).where("at <= IF(stratum = 0, 50, 7)")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), keys
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.rindex("MapInArrow") :]
    assert sample.candidates(df.limit(0), ["i"], strata).count() == 0
    pairs = df.select(F.struct("i", "s").alias("p"), "i")  # a key of another type
    assert sample.candidates(pairs, ["p"], strata).groupBy("stratum").count().orderBy("stratum").collect() == [(0, 50), (1, 7)]


def test_month_names_in_calendar_order(spark):
    days = [datetime.date(2023, m, 1) for m in (3, 1, 1, 12)] + [datetime.date(2024, 1, 5)]
    df = spark.createDataFrame([(d, 1) for d in days], "d date, flag_status int")
    spec = AnalysisSpec([Metric("n", "count")], time_column="d", time_bucket="month")
    assert [tuple(r) for r in answer(df, spec).collect()] == [("January", 3), ("March", 1), ("December", 1)]
    by_year = ask(df, spec, "Which months of 2023 had the most?")
    assert [tuple(r) for r in by_year.collect()][0] == ("2023-01", 2)


def test_status_takes_no_part(spark):
    df = spark.createDataFrame([(1, 2)], "a int, flag_status int")
    with pytest.raises(Exception, match="flag_status"):
        answer(df, AnalysisSpec([Metric("n", "sum", "flag_status")], ["a"]))


def test_rate_rank_and_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", -1), ("c", 1)], "k string, v int")
    spec = AnalysisSpec([Metric("rate", "rate", condition="v < 0")], ["k"], order=analyze.DESCENDING, ranked=True)
    got = [tuple(r) for r in answer(df, spec).collect()]
    assert got == [("b", 100.0, 1, True), ("a", 50.0, 2, False), ("c", 0.0, 3, False)]


def test_order_words():
    assert analyze.order_of("Which has the MOST?") == analyze.DESCENDING
    assert analyze.order_of("how many minutes") == analyze.ASCENDING
    assert analyze.order_of("per month") is None
    assert analyze.month_bucket_of("in 2023?") == "year_month"


def test_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "k string, v int")
    for order, want in ((analyze.DESCENDING, "cba"), (analyze.ASCENDING, "bca")):
        assert "".join(r["k"] for r in analyze.order_result(df, order).collect()) == want


def test_context(spark):
    rows = [(1, 0, "user", "q one "), (1, 1, "assistant", "a\n1"), (1, 2, "user", "q2"), (1, 3, "assistant", "x" * 400), (1, 4, "user", "q3")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    (row,) = conversation.context_block(conversation.question_answers(df), 2).collect()
    lines = row["context"].split("\n")
    assert lines[1:5] == ["- Q1: q3", "  A1: ", "- Q2: q2", "  A2: " + "x" * 297 + "…"]
    assert row["n_turns"] == 2
    with pytest.raises(ValueError):
        conversation.last_turns(df, 11)


def test_pipe_tables(spark):
    texts = [
        (1, "intro\n| a | b |  |\n|---|---|---|\n| 1 | | |\n| 2 | x | |\nend"),
        (2, "only | one line"),
        (3, "h1|h2\n---|---"),
        (4, "a|b\r\nc|d"),
        (5, None),
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    got = pipe_tables(df, "id", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    cells = {(r["id"], r["row_no"], r["col_no"]): r["cell"] for r in got.collect()}
    assert cells == {
        (1, 0, 1): "a", (1, 0, 2): "b", (1, 1, 1): "1", (1, 1, 2): "", (1, 2, 1): "2", (1, 2, 2): "x",
        (4, 0, 0): "a", (4, 0, 1): "b", (4, 1, 0): "c", (4, 1, 1): "d",
    }
