from __future__ import annotations

import pytest

from dqspark.operators import impute
from dqspark.operators.columns import boolean_like, datetime_like
from dqspark.operators.impute import Strategy


def frame(spark):
    rows = [
        (0, None, "b", None, "Yes", None),
        (1, 1.0, None, True, "No", None),
        (2, 3.0, "a", None, None, None),
        (3, 9.0, "b", False, "No", None),
    ]
    return spark.createDataFrame(rows, "i int, n double, t string, f boolean, y string, e double")


def test_defaults(spark):
    df = frame(spark)
    fitted = impute.fit_all(df)
    got = {r["i"]: r for r in fitted.transform(df).collect()}
    assert got[0]["n"] == 3.0 and got[1]["t"] == "b" and got[0]["f"] is False and got[2]["y"] == "No"
    assert all(r["e"] is None for r in got.values())
    report = {r["column"]: r for r in fitted.report(spark, fitted.transform(df)).collect()}
    assert set(report) == {"n", "t", "f", "y", "e"}
    assert not report["e"]["success"] and report["e"]["missing_after"] == 4
    assert report["n"]["missing_pct_text"] == "25.0%" and report["n"]["missing_after"] == 0


def test_boolean_like_fill(spark):
    got = {r["i"]: r for r in impute.fill_boolean(frame(spark), ["f", "y"]).collect()}
    assert got[0]["f"] is False and got[2]["y"] == "No"
    got = {r["i"]: r for r in impute.fill_boolean(frame(spark), ["f", "y"], True).collect()}
    assert got[0]["f"] is True and got[2]["y"] == "Yes"


def test_kinds(spark):
    rows = [("Y", "enabled", "x", "2024-01-01", None), ("N", "Disabled", "y", "2024-01-02 10:00", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert boolean_like(df) == {"a": "N", "b": "Disabled"}
    assert datetime_like(df) == ["d"]
    only_yes = spark.createDataFrame([("Yes",), ("maybe",), ("no",)], "a string")
    assert boolean_like(only_yes) == {"a": "no"}


def test_text_without_values_gets_the_constant(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert [r["t"] for r in impute.fill_text(df).collect()] == ["Unknown", "Unknown"]


def test_drop_and_skip(spark):
    df = frame(spark)
    assert impute.fit(df, {"n": "drop", "t": "drop"}).transform(df).count() == 2
    assert impute.fit(df, {"n": "skip"}).transform(df).count() == 4


@pytest.mark.parametrize("name, strategy", [("t", Strategy.MEAN), ("f", Strategy.MEDIAN), ("t", Strategy.INTERPOLATE), ("n", Strategy.FORWARD_FILL)])
def test_senseless_strategies(spark, name, strategy):
    with pytest.raises(ValueError):
        impute.fit(frame(spark), {name: strategy})


@pytest.mark.parametrize("limit", [100_000, 1])
def test_many_distinct_values_take_the_other_way(spark, limit):
    rows = [(float(i), f"v{i % 60:02d}") for i in range(300)] + [(None, None), (7.0, "v07")]
    df = spark.createDataFrame(rows, "n double, t string")
    fitted = impute.fit(df, {"n": "median", "t": "mode"}, distinct_limit=limit)
    assert {f.column: f.value for f in fitted.fills} == {"n": 149.0, "t": "v07"}


def test_mean_of_whole_numbers_is_a_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert [r["n"] for r in impute.fill_numeric(df, strategy=Strategy.MEAN).orderBy("n").collect()] == [1.0, 1.5, 2.0]


def test_complete_date_texts_stay_text(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-01"), (2, "2024-01-02", None)], "i int, a string, b string")
    got = impute.fill_datetime(df, ["i"])
    assert dict(got.dtypes) == {"i": "int", "a": "string", "b": "timestamp_ntz"}
    assert got.where("b IS NULL").count() == 0
