from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqspark.operators import profile, stats
from dqspark.operators.columns import one_row


@pytest.mark.parametrize("limit", [100_000, 5])
@pytest.mark.parametrize("kind", ["skewed", "hot", "whole", "two"])
def test_quantiles_are_exact(spark, limit, kind):
    rng = random.Random(5)
    make = {
        "skewed": lambda i: rng.expovariate(0.01),
        "hot": lambda i: 3.25 if rng.random() < 0.4 else rng.gauss(0, 10),
        "whole": lambda i: float(i),
        "two": lambda i: float(i % 2),
    }[kind]
    values = [None if i % 17 == 0 else make(i) for i in range(4000)] + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = stats.quantiles(df, {"v": shares}, distinct_limit=limit)["v"]
    clean = [v for v in values if v is not None and v == v]
    assert got == pytest.approx([float(np.quantile(clean, p)) for p in shares], rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert stats.quantiles(df, {"v": [0.25, 0.75]})["v"] == [None, None]


def test_fixture_quartile(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (4,)], "v int")
    assert stats.quantiles(df, {"v": [0.5, 0.75]})["v"] == [3.0, 5.5]


@pytest.mark.parametrize("limit", [100_000, 0])
@pytest.mark.parametrize("values, wanted", [(["b", "a"], "a"), ([None, None, "a"], "a"), (["b", "b", "a"], "b")])
def test_mode(spark, limit, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert stats.modes(df, ["v"], distinct_limit=limit) == {"v": wanted}


@pytest.mark.parametrize("values", [[1.0, 2.0, 10.0, 3.0], [2.0, 2.0, 2.0], [1.0, 5.0, 5.0, 9.0, 30.0]])
def test_skewness(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = one_row(df, {"s": stats.skewness(F.col("v"), F.count("v"))})["s"]
    assert got == pytest.approx(pd.Series(values).skew())


def test_missing_correlation(spark):
    gaps = [(1, 1), (0, 0), (1, 1), (0, 1)]
    rows = [(None if a else "x", None if b else 1, 5) for a, b in gaps]
    df = spark.createDataFrame(rows, "a string, b int, c int")
    (row,) = profile.missing_correlation(df).collect()
    assert (row["column1"], row["column2"]) == ("a", "b")
    assert row["correlation"] == pytest.approx(0.57735, abs=1e-5)


def test_suggestions(spark):
    rows = [(i, None if i % 2 else "x", None if i % 3 else 1.0, None if i % 5 else f"t{i}", None if i < 2 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a string, b double, c string, d int")
    got = {r["column"]: r["suggested_strategy"] for r in profile.missing_profile(df).collect()}
    assert got == {
        "a": "mode (categorical)",
        "b": "Consider dropping column or using constant value",
        "c": "Consider dropping column or using constant value",
        "d": "median (low missing rate)",
    }


def test_profile_without_gaps(spark):
    assert profile.missing_profile(spark.range(3)).count() == 0


def test_column_info_approx(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (2, None)], "n int, t string")
    for approx in (False, True):
        rows = {r["column"]: r for r in profile.column_info(df, approx=approx).collect()}
        assert rows["n"]["unique_count"] == 2 and rows["n"]["max"] == 2.0
        assert rows["t"]["samples"] == ["a", "b"] and rows["t"]["null_count"] == 1


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert profile.table_profile(df).first()["n_missing"] == 1


def test_many_columns_share_the_rounds(spark):
    """A hundred columns, no arrays in any result row, exact."""
    import unittest.mock as mock

    rng = np.random.default_rng(4)
    df = spark.range(3000).select(*[(F.hash("id", F.lit(i)) % (50 + 40 * i)).cast("double").alias(f"c{i}") for i in range(100)])
    values = df.toPandas()
    shares = [0.25, 0.5, 0.75]
    rows = []

    def kept(frame, columns):
        rows.append(one_row(frame, columns))
        return rows[-1]

    with mock.patch.object(stats, "one_row", kept):
        got = stats.quantiles(df, {c: shares for c in df.columns}, distinct_limit=0)
    assert got == {c: pytest.approx([float(np.quantile(values[c], p)) for p in shares]) for c in df.columns}
    assert not any(isinstance(v, list) for r in rows for v in r.values())
    assert rng is not None and len(rows) <= 1 + 2 * 5


def test_quantiles_beyond_the_sketch(spark, monkeypatch):
    """Sketches that cannot hold the values, and an error they do not keep: counts put it right."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.hash("id").cast("double")).otherwise(F.lit(7.0)).alias("v"))
    clean = [r["v"] for r in df.collect()]
    shares = [0.0, 0.1, 0.5, 0.51, 0.99, 1.0]
    want = pytest.approx([float(np.quantile(clean, p)) for p in shares], rel=1e-12)
    for size, error in ((64, 0.05), (64, 0.0), (8, 0.0)):
        monkeypatch.setattr(stats, "SKETCH", size)
        monkeypatch.setattr(stats, "SKETCH_ERROR", error)
        assert stats.quantiles(df, {"v": shares}, distinct_limit=0)["v"] == want


def test_modes_of_many_values(spark):
    """A value that stands out is certified without a group-by; close ones are counted whole; NaN and null do not count."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 == 0, F.lit("often")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), "id")).alias("a"),
        F.col("id").alias("b"),
        F.when(F.col("id") % 4 == 0, float("nan")).when(F.col("id") % 9 == 0, 2.5).otherwise(F.col("id").cast("double")).alias("c"),
        F.when(F.col("id") % 2 == 0, F.to_date(F.lit("2024-01-02"))).otherwise(F.date_add(F.to_date(F.lit("2000-01-01")), F.col("id").cast("int"))).alias("d"),
        F.lit(None).cast("string").alias("e"),
        F.when(F.col("id") % 5 == 0, "x").when(F.col("id") % 5 == 1, "w").otherwise(F.concat(F.lit("u"), "id")).alias("f"),
    )
    sure = stats._frequent_modes(df, df.columns)
    assert set(sure) == {"a", "c", "d", "e", "f"}
    got = stats.modes(df, df.columns, distinct_limit=0)
    assert (got["a"], got["b"], got["c"], str(got["d"]), got["e"], got["f"]) == ("often", 0, 2.5, "2024-01-02", None, "w")


def test_correlation_of_a_wide_table(spark):
    rng = np.random.default_rng(6)
    gaps = rng.random((300, 130)) < 0.3
    gaps[:, 70] = gaps[:, 3]
    gaps[:, 129] = ~gaps[:, 3]
    rows = [tuple(None if g else 1 for g in r) for r in gaps.tolist()]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(130)))
    got = {(r["column1"], r["column2"]): r["correlation"] for r in profile.missing_correlation(df, 0.25).collect()}
    like = np.corrcoef(gaps.T)
    want = {(f"c{a}", f"c{b}"): like[a, b] for a in range(130) for b in range(a + 1, 130) if abs(like[a, b]) > 0.25}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert got["c3", "c70"] == pytest.approx(1) and got["c3", "c129"] == pytest.approx(-1)


def test_distinct_digests_and_samples(spark):
    """Long texts count by digests; samples are the smallest values; nothing but digests is shuffled."""
    rows = [("x" * 100 + str(i % 5), i % 3, None if i % 2 else "b") for i in range(60)] + [("short", None, "a"), ("", 1, None)]
    df = spark.createDataFrame(rows, "t string, n int, u string")
    got = {r["column"]: r for r in profile.column_info(df).collect()}
    assert {c: r["unique_count"] for c, r in got.items()} == {"t": 7, "n": 3, "u": 2}
    assert got["t"]["samples"] == ["", "short", "x" * 100 + "0"] and got["u"]["samples"] == ["a", "b"]
    plan = profile.distinct_counts(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchange and all("digest" in line or "at" in line for line in exchange)


def test_sketches_merge_and_compare(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("k"), F.concat(F.lit("text " * 10), F.col("id") % 40).alias("t"))
    parts = [profile.distinct_sketches(df.where(F.col("id") % 2 == i), ["k", "t"]) for i in range(2)]
    merged = profile.merge_sketches(parts[0].unionByName(parts[1]))
    after = profile.distinct_sketches(df.where("k < 100").selectExpr("k + 50 AS k", "t"), ["k", "t"])
    got = {r["column"]: tuple(r)[1:] for r in profile.compare_sketches(merged, after).collect()}
    assert got["k"] == (300, 100, 100, 200, 0, 300)
    assert {r["column"]: r["n"] for r in merged.collect()} == {"k": 900, "t": 900}
