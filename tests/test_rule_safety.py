"""Stored rules: what is refused, what runs, which flags they get."""

from __future__ import annotations

import pytest

from dqspark.operators import flags, rules
from dqspark.operators.rules import Rule


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("x", 0, 1.5), ("7", 2, float("nan")), (None, None, None)], "`from` string, n int, d double").selectExpr("*", "DATE'2024-02-03' AS day")


@pytest.mark.parametrize(
    "code",
    [
        "java_method('java.lang.System', 'getProperty', 'user.dir') = 'x'", "reflect('java.lang.Math', 'abs', n) > 1", "rand() > 0.5",
        "uuid() = 'a'", "input_file_name() = 'a'", "raise_error('x')", "n IN (SELECT 1)", "EXISTS (SELECT 1)", "assert_true(n > 1)",
        "current_timestamp() > day", "sum(n) > 1", "explode(array(1)) > 1", "n +", "no_such_function(n)",
    ],
)
def test_refused(df, code):
    assert rules.check_rule(df, Rule(code, ("n", "day"), "r"))


@pytest.mark.parametrize("code", ["extract(year from day) > 2000", "`from` = 'select a from b'", "`from` > 5", "1 / n > 0", "n IN (1, 2)", "NOT (n BETWEEN 1 AND 2)"])
def test_allowed(df, code):
    assert rules.check_rule(df, Rule(code, ("n", "day", "from"), "r")) == ""


def test_one_bad_value_stops_nothing(spark, df):
    listed = [Rule("`from` > 5", ("from",), "a"), Rule("1 / n > 0.4", ("n",), "b"), Rule("cast(`from` AS INT) = 7", ("from",), "c"), Rule("n IS NULL", ("n",), "d")]
    got = flags.flag_rows(df, listed).data.orderBy("n").select("n", "flag_status").collect()
    assert [tuple(r) for r in got] == [(None, 8), (0, 0), (2, 1 + 2 + 4)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_flags_are_unique():
    one = lambda f: Rule("true", (), "r", f)
    assert [r.flag_value for r in rules.numbered([one(2), one(0), one(0), one(1)])] == [2, 4, 8, 1]
    for bad in ([one(2), one(2)], [one(3)], [one(-1)], [one(1 << 63)], [one(0)] * 64):
        with pytest.raises(ValueError):
            rules.numbered(bad)


def test_too_many_flags_are_refused(spark):
    many = spark.range(64).selectExpr("id AS flag_value", "'d' AS description")
    with pytest.raises(ValueError):
        flags.possible_combinations(many)
    few = many.limit(3).selectExpr("shiftleft(1L, CAST(flag_value AS INT)) AS flag_value", "description")
    got = flags.possible_combinations(few, most=4).collect()
    assert len(got) == 3 and {(int(r["in_all"]), r["listed_in_full"]) for r in got} == {(7, False)}
    assert len(flags.possible_combinations(few, most=None).collect()) == 7


def test_headers_are_held_together(spark, tmp_path):
    from dqspark.sources.readers import read_csv

    (tmp_path / "a.csv").write_text("x,y\n1,a\n")
    (tmp_path / "b.csv").write_text("y,x\nc,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), "x string, y string").collect()


def test_rules_are_checked_from_several_threads(spark, df):
    """Threads that check and flag at once leave the session's setting as it was and get their own results."""
    from concurrent.futures import ThreadPoolExecutor

    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)

    def work(i):
        bad = rules.check_rule(df, Rule("no_such_function(n)", ("n",), "r"))
        good = rules.check_rule(df, Rule(f"`from` > {i}", ("from",), "r"))
        rows = flags.flag_rows(df, [Rule(f"`from` > {i}", ("from",), "r"), Rule("1 / n > 0", ("n",), "r")]).data.collect()
        return bool(bad), good, sorted(r["flag_status"] for r in rows)

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(work, range(12)))
    assert all(g == (True, "", [0, 0, 3 if i < 7 else 2]) for i, g in enumerate(got))
    assert spark.conf.get(key) == before
