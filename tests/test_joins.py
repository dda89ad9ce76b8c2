from __future__ import annotations

import pytest

from dqspark.operators.joins import JoinSpec, join_chain, join_summary, join_tables


def rows(df):
    return sorted(tuple(r) for r in df.collect()) if not any(None in tuple(r) for r in df.collect()) else sorted(
        (tuple(r) for r in df.collect()), key=repr
    )


def test_missing_keys_meet(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (None, "q"), (2, "r")], "k int, b string")
    got = {how: rows(join_tables(a, b, JoinSpec("b", "k", "k", how))) for how in ("inner", "left", "right", "outer")}
    both = [(None, "x", "p"), (None, "x", "q")]
    assert got["inner"] == both
    assert set(got["left"]) == {*both, (1, "y", None)}
    assert set(got["right"]) == {*both, (2, None, "r")}
    assert set(got["outer"]) == {*both, (1, "y", None), (2, None, "r")} and len(got["outer"]) == 4


def test_outer_with_two_key_names(spark):
    a = spark.createDataFrame([(1, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "r")], "j int, b string")
    df = join_tables(a, b, JoinSpec("b", "k", "j", "outer"))
    assert df.columns == ["k", "a", "j", "b"]
    assert set(rows(df)) == {(1, "y", 1, "p"), (3, "z", None, None), (None, None, 2, "r")}


def test_key_types(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1.0, "p"), (2.5, "q")], "k double, b string")
    c = spark.createDataFrame([("1", "p"), ("01", "q")], "k string, c string")
    assert rows(join_tables(a, b, JoinSpec("b", "k", "k", "inner"))) == [(1.0, "p")]
    assert rows(join_tables(a, c, JoinSpec("c", "k", "k", "inner"))) == [("1", "p")]


def test_name_clash_and_chain(spark):
    a = spark.createDataFrame([(1, "a")], "k int, name string")
    b = spark.createDataFrame([(1, "b")], "k int, name string")
    tables = {"a": a, "b": b, "c": b}
    chain = [JoinSpec("b", "k", "k"), JoinSpec("c", "k", "k", "left", ["name"])]
    df = join_chain(tables, "a", chain)
    assert df.columns == ["k", "name", "name_b", "name_c"]
    assert rows(df) == [(1, "a", "b", "b")]
    assert join_summary(spark, "a", chain).first()["description"] == "left join with b on k=k"


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        join_tables(spark.range(1), spark.range(1), JoinSpec("b", "id", "id", "cross"))


def test_decimal_keys_keep_their_digits(spark):
    from decimal import Decimal as D

    a = spark.createDataFrame([(D("1.000000000000001"), "x"), (D("1.000000000000000"), "y")], "k decimal(20,15), a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k bigint, b string")
    got = join_tables(a, b, JoinSpec("b", "k", "k", "left"))
    assert rows(got.where("b IS NOT NULL").select("a", "b")) == [("y", "p")]
    assert {r["k"] for r in got.collect()} == {D("1.000000000000001"), D("1.000000000000000")}
    outer = join_tables(a, b, JoinSpec("b", "k", "k", "outer"))
    assert {r["k"] for r in outer.collect()} == {D("1.000000000000001"), D(1), D(3)}


def test_decimals_without_a_common_type(spark):
    from decimal import Decimal as D

    a = spark.createDataFrame([(D(10) ** 30, "big"), (D(2), "two"), (None, "none")], "k decimal(38,0), a string")
    b = spark.createDataFrame([(D("2.0"), "p"), (D("0.5"), "q"), (None, "n")], "k decimal(38,37), b string")
    for how, n in (("inner", 2), ("left", 3), ("right", 3), ("outer", 4)):
        df = join_tables(a, b, JoinSpec("b", "k", "k", how))
        assert df.count() == n
        assert ("two", "p") in {(r["a"], r["b"]) for r in df.collect()} and ("none", "n") in {(r["a"], r["b"]) for r in df.collect()}
    c = spark.createDataFrame([(1e30, "p"), (2.0, "q"), (float("nan"), "r"), (-0.1, "s"), (float("inf"), "t")], "k double, c string")
    got = {(r["a"], r["c"]) for r in join_tables(a, c, JoinSpec("c", "k", "k", "inner")).collect()}
    assert got == {("big", "p"), ("two", "q"), ("none", "r")}
    d = spark.createDataFrame([(D("-0.10"), "m"), (D("12.50"), "n")], "k decimal(10,2), d string")
    assert rows(join_tables(d, c, JoinSpec("c", "k", "k", "inner")).select("d", "c")) == [("m", "s")]


def test_join_decimal_keys_of_any_size(spark, tmp_path):
    """The query's keys may have as many digits as a bigint."""
    from decimal import Decimal as D
    from decimal import localcontext

    from dqspark.queries import QUERIES

    big = 2**63 - 1
    orders = [(1, 99_999), (2, 100_000), (3, 100_000), (4, big), (5, -big - 1), (6, big), (7, None), (8, 7)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(99_999, "a"), (100_000, "b"), (big, "c"), (-big - 1, "d"), (None, "e")]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["o_orderkey"]: (r["k"], r["j"], r["c_name"]) for r in QUERIES["join_decimal_keys"](spark, str(tmp_path)).collect()}
    bit = D("0.000000000000001")
    with localcontext(prec=40):
        assert got == {
            1: (99_999, 99_999, "a"), 2: (100_000, 100_000, "b"), 3: (100_000 + bit, None, None), 4: (big, big, "c"),
            5: (-big - 1, -big - 1, "d"), 6: (big + bit, None, None), 7: (None, None, "e"), 8: (7, None, None),
        }


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_split_join_is_the_join(spark, how):
    """Hot keys on both sides, on one only, missing on the other side, NULL among them, maps in the rows."""
    left = spark.range(3000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 5 = 0 THEN -1 WHEN id % 7 = 0 THEN 8 ELSE id END AS k", "id % 3 AS a", "map(1, id) AS m"
    )
    right = spark.range(400).selectExpr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN -2 ELSE id END AS j", "id AS b")
    plain = join_tables(left, right, JoinSpec("r", "k", "j", how))
    split = join_tables(left, right, JoinSpec("r", "k", "j", how, hot_rows=60))
    assert split.columns == plain.columns
    columns = ["k", "a", "j", "b", "m[1]"]

    def counted(df):
        return sorted(map(repr, df.selectExpr(*columns).groupBy("k", "a", "j", "b", "`m[1]`").count().collect()))

    assert counted(split) == counted(plain)


def test_no_task_holds_the_missing_key(spark):
    """Half of the looked-up side has no key: no task of the join gets more than twice the usual rows."""
    from dqspark.operators.joins import _split_join, hot_keys

    left = spark.range(64).selectExpr("CASE WHEN id < 4 THEN NULL ELSE id END AS k", "id AS a")
    right = spark.range(0, 40_000, 1, 16).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS j", "id AS b")
    assert list(hot_keys(right, "j", 1000).values()) == [20_000]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        joined = _split_join(left, right, "k", "j", "left", 250)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        sizes = joined.where("k IS NULL").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).collect()
        assert sum(sizes) == 80_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_copies_of_hot_rows_are_not_broadcast(spark, how):
    """Sides of a few kB, as Spark sees them, become thousands of copies: they are shuffled, whatever Spark may broadcast."""
    left = spark.range(400).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS k", "id AS a")
    right = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS j", "id AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        joined = join_tables(left, right, JoinSpec("r", "k", "j", how, hot_rows=5))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "__part_left" in line]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0]
        assert joined.where("k IS NULL AND j IS NULL AND a IS NOT NULL AND b IS NOT NULL").count() == 200 * 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
