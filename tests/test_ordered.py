"""Fills and ranks give the same in one window and cut into buckets."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pandas as pd
import pytest

from dqspark.operators.ordered import fill_ordered, rank_rows

HOWS = ("forward_fill", "backward_fill", "interpolate")


def fill(spark, values, how, **options):
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v double")
    rows = fill_ordered(df, {"v": how}, ["i"], **options).orderBy("i").collect()
    return [r["v"] for r in rows]


@pytest.mark.parametrize("size", [100, 2, 1])
@pytest.mark.parametrize(
    "how, wanted",
    [
        ("interpolate", [None, 1, 2, 3, 3]),
        ("forward_fill", [None, 1, 1, 3, 3]),
        ("backward_fill", [1, 1, 3, 3, None]),
    ],
)
def test_literal(spark, how, wanted, size):
    assert fill(spark, [None, 1.0, None, 3.0, None], how, rows_per_bucket=size) == wanted


def pandas_fill(series: pd.Series, how: str) -> pd.Series:
    return {"forward_fill": series.ffill, "backward_fill": series.bfill, "interpolate": series.interpolate}[how]()


def listed(values):
    return [None if pd.isna(v) else round(float(v), 9) for v in values]


@pytest.mark.parametrize("how", HOWS)
def test_buckets_match_pandas(spark, how):
    rng = random.Random(1)
    values = [None if rng.random() < 0.6 or 100 < i < 260 else rng.random() for i in range(600)]
    got = listed(fill(spark, values, how, rows_per_bucket=25))
    assert got == listed(pandas_fill(pd.Series(values, dtype="float64"), how))


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("size", [10_000, 40])
def test_hot_key_and_hot_order_value(spark, how, size):
    """Two thirds of the rows have one key, a third one order value, some a missing one."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        day = None if i % 50 == 0 else 5 if rng.random() < 0.35 else rng.randrange(30)
        rows.append((i, key, day, None if rng.random() < 0.5 else rng.random()))
    df = spark.createDataFrame(rows, "i bigint, k string, day int, v double")
    got = {
        r["i"]: r["v"] for r in fill_ordered(df, {"v": how}, ["day", "i"], ["k"], rows_per_bucket=size).collect()
    }
    pdf = pd.DataFrame(rows, columns=["i", "k", "day", "v"]).sort_values(["day", "i"], na_position="first")
    pdf["v"] = pdf["v"].astype("float64")
    want = pd.concat([pandas_fill(g["v"], how) for _, g in pdf.groupby("k", dropna=False)])
    assert len(got) == len(rows)
    assert listed(got[i] for i in pdf["i"]) == listed(want.loc[pdf.index])


@pytest.mark.parametrize("size", [1000, 20])
def test_several_columns_and_text_order(spark, size):
    rng = random.Random(3)
    names = [f"{rng.choice('äaBz')}{i:03d}" for i in range(200)]
    rows = [(n, None if rng.random() < 0.5 else "x" + n, None if rng.random() < 0.5 else i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "n string, t string, u int")
    got = fill_ordered(df, {"t": "forward_fill", "u": "backward_fill"}, ["n"], rows_per_bucket=size).collect()
    pdf = pd.DataFrame(rows, columns=["n", "t", "u"])
    pdf = pdf.iloc[sorted(range(len(rows)), key=lambda i: rows[i][0].encode())]
    want = dict(zip(pdf["n"], zip(pdf["t"].ffill(), pdf["u"].bfill())))
    clean = lambda v: None if pd.isna(v) else v
    assert {r["n"]: (r["t"], r["u"]) for r in got} == {n: (clean(t), clean(u)) for n, (t, u) in want.items()}


@pytest.mark.parametrize("size", [100, 2, 1])
def test_missing_order_value_comes_first(spark, size):
    rows = [(None, 5.0), (1, None), (2, None), (3, 7.0), (4, None)]
    df = spark.createDataFrame(rows, "i bigint, v double")
    ahead = fill_ordered(df, {"v": "forward_fill"}, ["i"], rows_per_bucket=size)
    assert {r["i"]: r["v"] for r in ahead.collect()} == {None: 5.0, 1: 5.0, 2: 5.0, 3: 7.0, 4: 7.0}
    rows[0] = (None, None)
    df = spark.createDataFrame(rows, "i bigint, v double")
    back = fill_ordered(df, {"v": "backward_fill"}, ["i"], rows_per_bucket=size)
    assert {r["i"]: r["v"] for r in back.collect()} == {None: 7.0, 1: 7.0, 2: 7.0, 3: 7.0, 4: None}


def test_time_interpolation(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    df = spark.createDataFrame([(0, day(1)), (1, None), (2, day(3)), (3, None)], "i int, t timestamp_ntz")
    rows = fill_ordered(df, {"t": "interpolate"}, ["i"]).orderBy("i").collect()
    assert [r["t"] for r in rows] == [day(1), day(2), day(3), day(3)]


def test_needs_order(spark):
    with pytest.raises(ValueError):
        fill_ordered(spark.range(3), {"id": "forward_fill"}, [])


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("size", [10_000, 30])
def test_rank(spark, descending, size):
    rng = random.Random(4)
    values = [None if i % 40 == 0 else 7.0 if rng.random() < 0.4 else float(rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r["i"]: r["rank"] for r in rank_rows(df, "v", descending, rows_per_bucket=size).collect()}
    want = pd.Series(values, dtype="float64").rank(method="min", ascending=not descending, na_option="bottom")
    assert got == {i: int(r) for i, r in enumerate(want)}


ORDERS = {
    "common head": ("string", lambda i: f"ORDER-000000{i:05d}"),
    "date text": ("string", lambda i: f"2024-01-{i % 28 + 1:02d}"),
    "big number": ("bigint", lambda i: 10**17 + i),
    "decimal": ("decimal(38,10)", lambda i: Decimal(10**20) + Decimal(i) / 1000),
    "date": ("date", lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 40)),
    "time": ("timestamp_ntz", lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=i)),
    "boolean": ("boolean", lambda i: i % 3 == 0),
    "double": ("double", lambda i: float("nan") if i % 7 == 0 else -i / 3),
    "one value": ("int", lambda i: None),
}


@pytest.mark.parametrize("kind", ORDERS)
def test_result_does_not_depend_on_buckets(spark, kind):
    type_name, make = ORDERS[kind]
    rng = random.Random(7)
    rows = [(make(i), i, rng.choice("ab"), None if rng.random() < 0.6 else float(i)) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"o {type_name}, id int, k string, v double")
    df = df.withColumns({how: df["v"] for how in HOWS})
    for keys in ([], ["k"]):
        runs = []
        for n in (1000, 20):
            rows = fill_ordered(df, {how: how for how in HOWS}, ["o", "id"], keys, rows_per_bucket=n).collect()
            runs.append({r["id"]: listed(r[how] for how in HOWS) for r in rows})
        assert runs[0] == runs[1]
    for descending in (True, False):
        ranks = [{r["id"]: r["rank"] for r in rank_rows(df, "o", descending, rows_per_bucket=n).collect()} for n in (1000, 20)]
        assert ranks[0] == ranks[1]


def test_large_side_moves_once(spark):
    """The carried table is joined without another exchange of the rows."""
    df = spark.range(400).selectExpr("id", "'hot' AS k", "IF(id % 3 = 0, id, NULL) AS v")
    filled = fill_ordered(df, {"v": "forward_fill"}, ["id"], ["k"], rows_per_bucket=50)
    plan = filled._jdf.queryExecution().optimizedPlan().toString() + filled._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
